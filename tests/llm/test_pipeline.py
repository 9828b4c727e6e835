import random
from itertools import combinations
from types import SimpleNamespace

import test_line_dedup
import test_packing
from pyspark.sql import functions as F

import corpus_pipeline
from kbflow.llm import secrets, simhash_dedup, toxicity


def tables(path, spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40))) + "."
    docs = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    docs = [(i, t + " you stupid rotten fool") if i % 6 == 0 else (i, t) for i, t in docs]
    docs += [(100 + i, t) for i, t in docs[1:4]]  # copies
    docs += [(200 + i, docs[i][1].replace(" ", "  ", 1) + " end") for i in (7, 8)]
    docs += [(300, None), (301, ""), (302, "password=abcdef123 stays here"), (None, "no id"), (303, "token: Zx9Kq2Lw8Vb3Nm5T and more")]
    frame = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2, int("fool" in t)) for i, t in docs[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def near(docs):
    """The ids that stay, by brute force over all pairs of fingerprints."""
    fps = {}
    for i, t in docs:
        found = simhash_dedup.hashes(t, 5)
        fps[i] = (simhash_dedup.of_hashes(found, 4), len(found))
    root = {i: i for i in fps}
    bits = lambda x, y: [(a ^ b).bit_count() for a, b in zip(x, y, strict=True)]
    pairs = [(i, j) for i, j in combinations(sorted(fps), 2) if sum(d := bits(fps[i][0], fps[j][0])) <= 46 and d[0] <= simhash_dedup.FIRST and min(fps[i][1], fps[j][1]) >= 0.8 * max(fps[i][1], fps[j][1])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return {i for i in fps if root[i] == i}


def test_stages_against_brute_force(spark, tmp_path):
    path = str(tmp_path)
    tables(path, spark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    held = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{path}/labels.parquet")
    for (name, stage), kind in zip(corpus_pipeline.STAGES, ("toxicity", "line_dedup", "simhash_dedup", "secret_scan", "packing"), strict=True):
        assert name == kind
        out = stage(spark, docs, path)
        if name == "packing":
            break
        assert out.columns == names
        out.write.parquet(f"{path}/{name}")
        out = spark.read.parquet(f"{path}/{name}")
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
            assert got == {i: t for i, t in held.items() if model.score(t) < toxicity.THRESHOLD}
            assert 3 < len(held) - len(got) < 20
        elif name == "line_dedup":
            assert set(got.items()) == test_line_dedup.slow(list(held.items()))
        elif name == "simhash_dedup":
            assert set(got) == near([(i, t) for i, t in held.items() if i is not None]) | ({None} & set(held)) and all(held[i] == t for i, t in got.items())
        else:
            own = secrets.limits(docs)
            assert got == {i: None if t is None else secrets.redact_text(t, own) for i, t in held.items()}
            assert got[302] == "[SECRET] stays here"
        assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in out.collect()) or name in ("toxicity", "simhash_dedup")
        docs, held = out, got
    rows = out.collect()
    least = lambda i: -1 if i is None else i
    test_packing.verify([SimpleNamespace(**r.asDict() | {"doc_id": least(r.doc_id)}) for r in rows], {least(i): t for i, t in held.items()})
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(corpus_pipeline.run(spark, path).collect(), key=key) == sorted(rows, key=key)
