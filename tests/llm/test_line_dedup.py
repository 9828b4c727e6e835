import random
import re
import unicodedata
from itertools import combinations

import duckdb
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kbflow.llm import line_dedup as L


def norm(line):
    out = re.sub("[0-9]", "0", line.lower())
    return re.sub(" +", " ", "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in out)).strip()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def like(a, b):
    if min(len(a), len(b)) > L.BY_CHARACTERS:
        a, b = a.split(" "), b.split(" ")
    return edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)


def slow(docs):
    """docs: (id, text), ids unique. The texts without repeated lines, by edit similarity of all pairs of lines and nothing else."""
    places = {}
    for i, t in sorted((d for d in docs if d[0] is not None and d[1] is not None)):
        for p, raw in enumerate(t.split("\n")):
            if len((line := norm(raw)).split(" ")) >= L.WORDS:
                places.setdefault(line, []).append((i, p))
    root = {x: x for x in places}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(places, 2):
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and top(x) != top(y) and like(x, y):
            root[top(x)] = top(y)
    groups = {}
    for x, own in places.items():
        groups.setdefault(top(x), []).extend(own)
    gone = {p for own in groups.values() for p in own if p != min(own)}
    return {(i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)) for i, t in docs}


def corpus(rng, n=40):
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "xyzuvw"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for line in lines[:30]:
        own = line.split(" ")
        own[rng.randrange(len(own))] = rng.choice(words)
        lines.append(" ".join(own))
        lines.append(line.upper() + "!")
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for i in range(n)]


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    docs = corpus(random.Random(6))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[3][1]), (104, "Éa b c d e f\n éA, b; c d (e) f!\n1 2 3 4 5\n9 8 7 6 5")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, gone int, th string")
    got = L.drop_lines(frame)
    assert got.columns == [*frame.columns, "n_lines", "n_removed"]
    rows = got.collect()
    want = slow(docs)
    assert {(r.doc_id, r.text) for r in rows} == want and len(rows) == len(docs)
    assert sum(r.n_removed for r in rows) > 50


def blocks(line, e):
    """The fingerprint and the blocks with words, by their definition."""
    own = [xxhash.xxh64_intdigest(w.encode(), 42) for w in dict.fromkeys(line.split(" "))]
    fp, found, width = 0, set(), 64 >> e
    for i in range(1 << e):
        mine = sorted((h - (1 << 64) if h >> 63 else h) for h in own if (h ^ 1 << 63) >> 64 - e == i)[: L.SAMPLE]  # signed order
        sim = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mine) > len(mine))
        fp |= sim & ((1 << width) - 1) << i * width
        found |= {(i, sim)} if mine else set()
    return fp, found


def test_fingerprints(spark):
    texts = {0: "a b c d e", 1: "é b c d e f g", 2: "w " * 300 + "x y z v u", 3: " ".join(f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), 4: "too few words here"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in L.fingerprints(frame).collect():
        got.setdefault(r.doc_id, {})[r.fp % (1 << 64)] = len(r["keys"])
    for i, es in ((0, (2,)), (1, (2,)), (2, (2,)), (3, (5,))):
        assert got[i] == {fp: len(own) for fp, own in (blocks(norm(texts[i]), e) for e in es)}
    assert 4 not in got


def test_two_sizes_of_blocks(spark):
    frame = spark.createDataFrame([(n, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))) for n in (24, 37, 38, 40, 41, 50)], "doc_id long, text string")
    rows = [(r.doc_id, r.main) for r in L.fingerprints(frame).collect()]
    assert sorted(rows) == [(24, True), (37, False), (37, True), (38, False), (38, True), (40, False), (40, True), (41, False), (41, True), (50, True)]


def test_candidates(spark):
    rng = random.Random(8)
    rows = [(i, rng.getrandbits(62), [rng.randrange(12), 100 + rng.randrange(6)]) for i in range(60)]
    rows += [(100 + i, fp ^ 1 << rng.randrange(60) ^ 1 << rng.randrange(60), keys) for i, fp, keys in rows]
    rows += [(1000 + i, 7, [5000]) for i in range(40)]  # more than a line is compared with
    got = {tuple(r) for r in L.candidates(spark.createDataFrame(rows, "id long, fp long, keys array<long>"), 4).collect()}
    for (a, x, k), (b, y, m) in combinations(rows, 2):
        share = set(k) & set(m)
        if (a, b) in got:
            assert share and (x ^ y).bit_count() <= 4
        elif share and (x ^ y).bit_count() <= 4:
            assert all(sum(s in o[2] for o in rows) > L.NEXT + 1 for s in share)
    assert {(1000, 1000 + i) for i in range(1, 40)} <= got


def test_odd_rows(spark):
    line = "one two three four five six"
    rows = [(None, line), (3, line), (3, line), (3, line + " seven eight nine ten\n" + line), (None, line)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in L.drop_lines(frame).collect()), key=str)
    assert [g for g in got if g[0] is None] == [(None, line)] * 2
    own = [t for i, t in got if i == 3]
    assert len(own) == 3 and sum(line in t.split("\n") for t in own) in (1, 2)
    assert L.drop_lines(frame.limit(0)).count() == 0


def replaced(rng, least, most, n):
    """Pairs of lines that differ in one word, and are like by far."""
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(5000)]
    out = []
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(least, most + 1))]
        other = list(own)
        other[rng.randrange(len(own))] = rng.choice(words)
        out.append((" ".join(own), " ".join(other)))
    return out


def recall(spark, pairs):
    frame = spark.createDataFrame([(2 * i + side, line) for i, p in enumerate(pairs) for side, line in enumerate(p)], "doc_id long, text string")
    return sum(r.n_removed for r in L.drop_lines(frame).collect()) / len(pairs)


def test_recall_of_replaced_words(spark):
    rng = random.Random(11)
    for least, most, share in ((5, 9, 0.7), (10, 19, 0.9), (20, 49, 0.99), (50, 99, 0.99)):
        pairs = replaced(rng, least, most, 200)
        alike = [p for p in pairs if like(*p)]
        assert len(alike) > 60
        got = recall(spark, alike)
        assert got > share, (least, got)


def test_recall_against_edit_similarity(spark, sf):
    """Of all pairs of lines of a table that are like by edit similarity alone, those that come out in one group."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lines = sorted({x for r in docs.collect() for raw in (r.text or "").split("\n") if len((x := norm(raw)).split(" ")) >= L.WORDS and len(x) < 400})
    db = duckdb.connect()
    held = pa.table({"i": list(range(len(lines))), "x": lines})  # noqa: F841
    want = db.sql("SELECT a.i, b.i FROM held a JOIN held b ON a.i < b.i AND least(length(a.x), length(b.x)) >= 0.8 * greatest(length(a.x), length(b.x)) WHERE levenshtein(a.x, b.x) <= floor(0.2 * greatest(length(a.x), length(b.x)) + 1e-9)").fetchall()
    assert len(want) > 20
    found = 0
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    texts = L.Table(L.fingerprints(frame), "lines").df
    own = texts.where("main").select("h", F.struct("doc_id", "th", "pos").alias("first"), F.lit(1).alias("k"))
    like_ids = L.links(frame, own, texts)
    group = {r.node: r.component for r in L.components(like_ids, "a", "b").collect()}
    of = {r.doc_id: r.id for r in texts.where("main").select("doc_id", F.xxhash64("h").alias("id")).collect()}
    found = sum(group.get(of[a], a) == group.get(of[b], b) for a, b in want)
    assert found >= 0.9 * len(want), (found, len(want))


def test_long_lines_by_words(spark):
    rng = random.Random(14)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    few, many, half = list(base), list(base), list(base)
    for own, n in ((few, 90), (many, 400), (half, 0)):
        for k in rng.sample(range(900), n):
            own[k] = f"new{'x' * (k % 7)}{own[k]}"
    docs = [(1, " ".join(base)), (2, " ".join(few)), (3, " ".join(many)), (4, " ".join(half[:450]))]
    got = {r.doc_id: r.n_removed for r in L.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_same_words_in_other_orders(spark):
    """Lines of one fingerprint that are not all like."""
    rng = random.Random(13)
    lines = []
    for _ in range(2):
        base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(50)]
        for _ in range(3):
            own = rng.sample(base, 50)
            lines += [" ".join(own), " ".join([*own, own[0]])]
    rng.shuffle(lines)
    docs = list(enumerate(lines))
    got = {(r.doc_id, r.text) for r in L.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == slow(docs) and sum(t != "" for _, t in got) == 6


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "one two three four five", 9, 9, 9, 9)], "doc_id long, text string, n_lines int, n_removed int, id int, line int")
    row = L.drop_lines(frame).first()
    assert (row.n_lines, row.n_removed, row.id, row.line) == (1, 0, 9, 9)


def test_larger_blocks_are_compared_whole(spark):
    """Lines with a long run in common lie in blocks of far more lines than one meets first; two of them are like."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    common = [word() for _ in range(24)]
    rows = [(i, rng.getrandbits(60), [1, 2]) for i in range(200)]
    rows += [(1000 + i, fp ^ sum(1 << b for b in rng.sample(range(60), 6)), [2, 3]) for i, fp, _ in rows]
    want = {(a, b) for (a, x, k), (b, y, m) in combinations(rows, 2) if set(k) & set(m) and (x ^ y).bit_count() <= 12}
    got = L.candidates(spark.createDataFrame(rows, "id long, fp long, keys array<long>")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) >= 200
    # of three tiles, and with groups: pairs of one group are left out
    met = L.Table(L.blocks(spark.createDataFrame([(*r, 9) for r in rows], "id long, fp long, keys array<long>, n int")), "blocks").df
    groups = spark.createDataFrame([(i, i % 3) for i in range(200)], "id long, group long")
    of = lambda i: i % 3 if i < 200 else i
    rest = {tuple(r) for r in L.rest(met, groups, tile=150).collect()}
    assert rest == {(a, b) for a, b in want if of(a) != of(b)}
    # whole lines: pairs of lines with own words around the common run
    pairs = []
    for _ in range(60):
        own = [*(word() for _ in range(12)), *common, *(word() for _ in range(12))]
        other = list(own)
        for k in (2, 40, 45):
            other[k] = word()
        pairs.append((" ".join(own), " ".join(other)))
    lines = [x for p in pairs for x in p]
    rng.shuffle(lines)
    docs = list(enumerate(lines))
    got = {(r.doc_id, r.text) for r in L.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == slow(docs) and sum(t == "" for _, t in got) == 60


def test_larger_blocks_meet_once(spark):
    """Each two lines of a larger block meet in one row, in one tile or in two."""
    rows = [(i, i, [1], 9) for i in range(40)]
    met = L.Table(L.blocks(spark.createDataFrame(rows, "id long, fp long, keys array<long>, n int")), "blocks").df
    none = spark.createDataFrame([], "id long, group long")
    for tile in (150, 16):
        got = [tuple(sorted((r.x.id, r.y.id))) for r in L.meets(met, none, tile).collect()]
        assert sorted(got) == list(combinations(range(40), 2))


def test_lengths_rule_out_first_pairs(spark):
    """Lines whose lengths lie too far apart are no pairs whose texts are looked up; those at the bound stay."""
    rows = [(1, 7, [1], 100), (2, 7, [1], 79), (3, 7, [1], 78), (4, 7, [2], 50), (5, 7, [2], 10)]
    met = L.blocks(spark.createDataFrame(rows, "id long, fp long, keys array<long>, n int"))
    assert {tuple(r) for r in L.first(met).collect()} == {(1, 2), (2, 3)}
