import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kbflow.llm import simhash_dedup as S


def slow_fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows):
    """Smallest reachable id by brute force; rows: (id, fingerprint)."""
    own = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, f in rows:
            for j, g in rows:
                if (f ^ g).bit_count() <= 2 and own[j] < own[i]:
                    own[i], changed = own[j], True
    return own


def test_fingerprint():
    for text in ["", None, "A", "a b", "A b C", "a b c d e f g " * 30, "Übung macht den Meister\n x y", "x" * 5000 + " y z w", "a\x0bb\x0cc"]:
        assert S.fingerprint(text) == (slow_fingerprint(text),)
        assert S.fingerprint(text, 3, 4)[0] == slow_fingerprint(text) and len(set(S.fingerprint("a b c d e", 3, 4))) == 4


def test_tile_links_match_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 63, 40, dtype=np.uint64)) for _ in range(20)] + [rng.integers(0, 2**63, 700, dtype=np.uint64)]))
    rng.shuffle(fps)
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    side = lambda x: S.Side(x, np.ones(len(x), np.int64), False)
    p, q = S.tile_links(side(fps), None, 2)
    assert len(p) < len(fps)
    assert (S.forest(len(fps), p, q) == S.forest(len(fps), x, y)).all()
    a, b = fps[:500], fps[500:]
    p, q = S.tile_links(side(a), side(b), 2)
    x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 2)
    assert (S.forest(len(fps), p, q) == S.forest(len(fps), x, y + 500)).all()


def test_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, docs[5][1]), (1004, "one"), (1005, "ONE"), (1005, "ONE")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, fp string, component_id int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(frame).collect()]
    rows = [(i, slow_fingerprint(t)) for i, t in docs]
    own = slow_classes(rows)
    assert sorted(got) == sorted((i, f"{f:016x}", own[i]) for i, f in rows)
    few = S.one_of_each(frame, n=3, radius=2)
    assert few.columns == frame.columns
    assert sorted(r.doc_id for r in few.collect()) == sorted({i for i, _ in rows if own[i] == i})


def test_tiles_do_not_change_classes(spark):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 2**62, 300)]
    fps += [f ^ 1 << int(b) for f in fps[:100] for b in rng.integers(0, 62, 2)]
    rows = [(bytearray(f.to_bytes(8, "little")), f, f.bit_count(), 1) for f in dict.fromkeys(fps)]
    got = S.components(S.links(spark.createDataFrame(rows, "fp binary, node long, pc long, n long"), tile=16), "a", "b")
    own = slow_classes([(f, f) for _, f, _, _ in rows])
    assert {r.node: r.component for r in got.collect()} == {i: c for i, c in own.items() if sum(own[j] == c for j in own) > 1}


def test_wide_fingerprints_by_size(spark):
    """All pairs of wide fingerprints within the radius and the ratio, by brute force."""
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        fp, n = rng.getrandbits(256), rng.randrange(1, 60)
        rows += [(fp, n), *((fp ^ sum(1 << b for b in rng.sample(range(256), k)), max(1, n * d // 10)) for k, d in ((3, 10), (30, 9), (44, 12), (46, 7), (60, 10)))]
    rows = [(i, f, n) for i, (f, n) in enumerate(rows)]
    frame = spark.createDataFrame([(bytearray(f.to_bytes(32, "little")), i, f.bit_count(), n) for i, f, n in rows], "fp binary, node long, pc long, n long")
    own = {i: i for i, _, _ in rows}
    changed = True
    pairs = [(i, j) for i, f, n in rows for j, g, m in rows if i < j and (f ^ g).bit_count() <= 46 and min(n, m) >= 0.8 * max(n, m)]
    while changed:
        changed = False
        for i, j in pairs:
            if own[i] != own[j]:
                own[i] = own[j] = min(own[i], own[j])
                changed = True
    for tile in (32, 10**6):
        got = {r.node: r.component for r in S.components(S.links(frame, 46, 0.8, tile), "a", "b").collect()}
        assert {i: got.get(i, i) for i in own} == own


def test_near_copies_of_similarity(spark):
    """Near copies by five-word shingles: those of similarity 0.85 and more are found, those under 0.6 are not."""
    rng = random.Random(4)
    docs = []
    for k in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        few, many = list(own), list(own)
        few[rng.randrange(200)] = "x"
        for i in rng.sample(range(200), 20):
            many[i] = "y"
        docs += [(10 * k, " ".join(own)), (10 * k + 1, " ".join(few)), (10 * k + 2, " ".join(many))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("row", F.lit(2))
    few = S.one_of_each(frame)
    assert few.columns == frame.columns
    assert sorted(r.doc_id for r in few.collect()) == sorted([10 * k for k in range(40)] + [10 * k + 2 for k in range(40)])


def test_empty_and_null_ids(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = S.near_duplicates(spark.createDataFrame([(None, "a"), (4, "a"), (None, "zz")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_a_null_id_keeps_its_links(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (None, " ".join(words)), (9, " ".join(words))]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}
    fps = {1: 0b0, None: 0b11, 9: 0b1111}  # only the row without an id joins the others
    reps = spark.createDataFrame([(bytearray(f.to_bytes(8, "little")), f, f.bit_count(), 1) for f in fps.values()], "fp binary, node long, pc long, n long")
    assert {r.component for r in S.components(S.links(reps), "a", "b").collect()} == {0}


def test_wide_links_whatever_word_differs():
    """Near copies whose differing bits all lie in one word are found, be it the first."""
    rng = np.random.default_rng(19)
    base = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    other = base.copy()
    for i in range(300):
        for b in rng.choice(64, 40 + i % 7, replace=False):
            other[i, i % 4] ^= np.uint64(1) << np.uint64(b)
    far = base.copy()
    far[:, 0] ^= np.uint64((1 << 47) - 1)
    side = lambda fps: S.Side(fps, np.ones(len(fps), np.int64), True)
    p, q = S.tile_links(side(base), side(other), 46, 0.8)
    assert {(int(x), int(y) - 300) for x, y in zip(np.minimum(p, q), np.maximum(p, q), strict=True)} == {(i, i) for i in range(300)}
    assert not len(S.tile_links(side(base), side(far), 46, 0.8)[0])
