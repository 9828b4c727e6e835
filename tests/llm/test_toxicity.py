import zlib

import numpy as np

from kbflow.llm import toxicity as T


def test_features_against_sets():
    for text in ["", None, "ab", "Abc", "ÉÜ日本語 Zż 👩", "abcd abcd", "né " * 40, "x" * 3000]:
        raw = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text or ""]
        want = set()
        for n in T.NGRAMS:
            for i in range(len(raw) - n + 1):
                h = n
                for c in raw[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                h ^= h >> 15
                h = h * 0x2C1B3C6D & 0xFFFFFFFF
                want.add((h ^ h >> 13) & (1 << T.BITS) - 1)
        assert T.features(text).tolist() == sorted(want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = T.op9_toxicity(spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    caught = sum(p for p, t in held if t) / sum(t for _, t in held)
    wrong = sum(p for p, t in held if not t) / sum(1 - t for _, t in held)
    assert wrong < 0.01 and caught > 0.5, (caught, wrong)  # four of ten toxic labels of this table mark texts like all others


def test_labels_of_held_out_rows_teach_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    own = ~T.held_out(F.col("doc_id"))
    a = T.train(docs, labels.where(own))
    b = T.train(docs, labels.withColumn("toxic", F.when(own, F.col("toxic")).otherwise(1 - F.col("toxic"))).where(own))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_repeated_ids_and_the_bound(spark):
    docs = spark.createDataFrame([(1, "a fool"), (2, "kind words")] + [(1, "zz top")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    once = T.train(docs.dropDuplicates(["doc_id", "text"]), labels)
    assert (model.weights == once.weights).all() and model.score("a fool") > model.score("kind words")
    assert T.train(docs, labels, entries=3).score("a fool") == 0.5


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a fool and a fool", 0), (2, "kind words", 0), (None, None, 0), (2, "kind words", 0), (3, "", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    got = {(r.doc_id, round(r.score, 3)) for r in T.score(docs, model).collect()}
    assert len(T.score(docs, model).collect()) == 5 and len(got) == 4
    assert model.score("a fool") > 0.5 > model.score("kind words")
    assert T.reject(docs, model, threshold=2).count() == 5 and T.reject(docs, model).columns == docs.columns
    assert T.score(docs.limit(0), T.train(docs.limit(0), labels.limit(0))).count() == 0
    assert T.fit([], np.zeros(0)).score("x") == 0.5
