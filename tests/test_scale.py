"""What the searches do on groups of alike rows: exact ties, and work that grows no faster than the rows."""

import numpy as np
from pyspark.sql import functions as F

from kbflow.catalog import QUERIES
from kbflow.operators import knn, retrieval


def most_rows(df):
    """The largest number of rows that an operator of a collected query made."""

    def walk(plan):
        own = plan.metrics().get("numOutputRows")
        yield own.get().value() if own.isDefined() else 0
        name = plan.getClass().getSimpleName()
        children = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        for child in children:
            yield from walk(child)

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_hops_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    sets = [sorted({int(x) for x in rng.integers(0, 12, rng.integers(1, 7))}) for _ in range(80)]
    sets += sets[:20] + [list(range(5)), list(range(8)), list(range(12))]
    entities = spark.createDataFrame([*((d, f"e{e}") for d, s in enumerate(sets) for e in s), (None, "e1"), (500, None)], "d long, e string").cache()
    first = spark.createDataFrame([*((1000 + i, i % len(sets)) for i in range(len(sets) + 9)), (7, None), (8, 999)], "q long, d long").cache()
    want = knn.top(retrieval.entity_hop(first, entities), 6, score="overlap").select("q", "d", "overlap")
    want = sorted(tuple(r) for r in want.collect())
    for wide in (8, 4, 0):  # sets of more entities are compared by entity
        assert sorted(tuple(r) for r in retrieval.hop_top(first, entities, 6, wide).collect()) == want


def test_entity_hop_makes_no_pairs(spark, tmp_path):
    n = 2000  # documents of one set of entities were all paired with each other
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("old ring").alias("p_name"), F.lit(3).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(n).select(F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    own = QUERIES["jon_entity_hop"](spark, str(tmp_path)).where("d >= 0")
    rows = own.collect()
    assert len(rows) == 20 * n and {r.overlap for r in rows} == {2}
    assert sorted(r.d for r in rows if r.q == 5) == [i for i in range(21) if i != 5]
    assert most_rows(own) <= 20 * n


def test_features_keep_the_sign_of_zero(spark, tmp_path):
    import duckdb

    from kbflow.catalog import SQL

    # F2: a similarity between -0.0000005 and 0 is -0.0 in SQL
    rows = [(i, [1.0 if i % 10 else -3e-7, float(i % 7)], i % 3) for i in range(200)]
    rows = [(i, [v[0], 0.0] if i % 10 == 0 else v, c) for i, v, c in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("drf_features", "vec_unit", "vec_mean_pool"):
        got = QUERIES[name](spark, str(tmp_path))
        want = db.sql(SQL[name]).project(", ".join(f'"{c}"' for c in got.columns)).fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and (name != "drf_features" or "-0.0" in repr(want))


def test_search_holds_a_tile(spark):
    import tracemalloc

    import pyarrow as pa

    # all queries of a block times all documents of a batch were held several times, 1.6 GB a task
    rng = np.random.default_rng(11)
    q, d = rng.normal(size=(4096, 4)), rng.normal(size=(10_000, 4))
    batch = pa.record_batch([pa.array(np.arange(10_000)), pa.array(list(d), pa.list_(pa.float64()))], names=["d", "dv"])

    class Sent:
        value = (np.arange(4096), q, {None: np.arange(4096)})

    tracemalloc.start()
    (found,) = list(knn._best(Sent, 3, None)(iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak
    want = np.argsort(-(q[:50] @ d.T), axis=1)[:, :3]
    assert found.column(1).to_numpy().reshape(-1, 3)[:50].tolist() == want.tolist()


def test_search_of_copies(spark):
    # equal vectors have equal products wherever they stand, so the smaller ids are the nearest; a product by matrix may differ in its last bits
    rng = np.random.default_rng(12)
    v = rng.normal(size=(7, 37))
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(19, 37)))], "q long, qv array<double>").cache()
    ds = spark.createDataFrame([(int(i), v[i % 7].tolist(), int(i % 7)) for i in rng.permutation(2500)], "d long, dv array<double>, c long").repartition(3).cache()
    pairs = qs.crossJoin(ds).withColumn("sim", knn.dot("qv", "dv")).cache()
    rows = lambda df: sorted((r.q, r.d, r.sim, r["rank"]) for r in df.collect())
    want = rows(knn.top(pairs.select("q", "d", "sim"), 5))
    assert rows(knn.nearest(qs, ds, 5)) == want and rows(knn.nearest(qs, ds, 5, 4)) == want
    assert rows(knn.nearest(qs, ds, 5, digits=1)) == rows(knn.top(pairs.select("q", "d", F.bround("sim", 1).alias("sim")), 5))


def test_probe_makes_no_pairs(spark):
    rng = np.random.default_rng(13)
    unit = rng.normal(size=(3, 8))
    ds = spark.createDataFrame([(i, (unit[i % 3] + rng.normal(size=8) / 9).tolist(), i % 3) for i in range(3000)], "d long, dv array<double>, c long").repartition(4).cache()
    cs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "c long, cv array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "q long, qv array<double>").cache()
    chosen = knn.nearest(qs, cs.selectExpr("c AS d", "cv AS dv"), 2).select("q", F.col("d").alias("c"))
    pairs = chosen.join(qs, "q").join(ds, "c").withColumn("sim", knn.dot("qv", "dv")).select("q", "d", "sim")
    found = knn.probe(qs, cs, ds, 2, 5)
    rows = lambda df: sorted((r.q, r.d, r.sim, r["rank"]) for r in df.collect())
    assert rows(found) == rows(knn.top(pairs, 5))
    assert most_rows(found) <= 300 * 5 * 4 * 2  # F8: each query met all documents of its clusters as a row, 600,000 here


def test_arrivals_of_all_windows(spark):
    from kbflow.operators import loop
    from kbflow.operators.stream import order_key

    rng = np.random.default_rng(14)
    pool = spark.createDataFrame([(i, rng.normal(size=4).tolist(), 0) for i in range(300)], "d long, dv array<double>, label int").cache()
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i) for i in range(60)], "q long, qv array<double>, window_idx long").cache()
    first = lambda w: [r.d for r in pool.orderBy(order_key(f"arrive|{w}", "d"), "d").limit(5).collect()]
    found = {r.window_idx: [x.d for x in r.come] for r in loop.arrivals(queries.select("window_idx"), pool, 5, 0.1).collect()}
    assert len(found) == 60 and all(found[w] == first(w) for w in (0, 7, 59))
    few = loop._coming(queries, pool, 60, 3)  # of more documents than the share holds in every window
    assert [len(few(w)) for w in (3, 8)] == [60, 60] and [r.d for r in few(9)][:5] == first(9)
    spark.sparkContext.setJobGroup("arrivals", "F9: a job for each window")
    rows = loop.run("arrivals", queries, pool, pool.where("d < 12"), queries.selectExpr("q", "q AS d"), 0.9, 12, arriving=5)
    assert len(rows) == 60 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("arrivals")) < 60
