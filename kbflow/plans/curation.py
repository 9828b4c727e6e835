"""Curation of a knowledge base: interests, coverage, candidates, features of drift, decisions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from kbflow.functions import vectors as V
from kbflow.operators import fold, knn
from kbflow.operators import retrieval as R
from kbflow.plans import vectors as B
from kbflow.plans.register import query, read

#: Interests are the topics of the queries: their mean vectors, and weights by their share.
_INTEREST = f"""{B.BASE}, X AS (SELECT q_label AS c, i, avg(x) AS m FROM (SELECT q_label, unnest(qv) AS x, generate_subscripts(qv, 1) AS i FROM Q) GROUP BY q_label, i),
CV AS (SELECT c, list(m ORDER BY i) AS cv FROM X GROUP BY c), CW AS (SELECT q_label AS c, count(*) / sum(count(*)) OVER ()::DOUBLE AS alpha FROM Q GROUP BY q_label)"""


def interests(spark, sf):
    """(c, cv, alpha): a mean vector and a weight for each topic of the queries."""
    q = B.queries(spark, sf)
    m = q.select(F.col("q_label").alias("c"), F.posexplode("qv").alias("i", "x")).groupBy("c", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cv = m.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("own")).select(F.col("c").cast("long").alias("c"), F.transform("own", lambda x: x["m"]).alias("cv"))
    n = q.agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = q.groupBy(F.col("q_label").cast("long").alias("c")).agg(F.count(F.lit(1)).alias("k")).crossJoin(n).select("c", (F.col("k") / F.col("n")).alias("alpha"))
    return cv.join(w, "c")


@query(f"WITH {_INTEREST}, S1 AS (SELECT c, max(list_inner_product(cv, dv)) AS best FROM CV, KB GROUP BY c) SELECT round(sum(alpha * best), 6) AS coverage, count(*) AS interests FROM S1 JOIN CW USING (c)")
def cur_interest_coverage(spark, sf):
    """What the knowledge base has for each interest, by weight."""
    own = interests(spark, sf).select(F.col("c").alias("q"), F.col("cv").alias("qv"), "alpha")
    best = knn.pairs(own, B.kb(spark, sf), B.BUDGET).groupBy("q", "alpha").agg(F.max("sim").alias("best"))
    return best.agg(F.round(F.sum(F.col("alpha") * F.col("best")), 6).alias("coverage"), F.count(F.lit(1)).alias("interests"))


@query(f"WITH {B.BASE}, S1 AS (SELECT P.d, max(list_inner_product(P.dv, KB.dv)) AS best FROM P, KB GROUP BY P.d) SELECT round(avg(best), 6) AS diversity, round(min(best), 6) AS worst, count(*) AS n FROM S1")
def cur_facility_coverage(spark, sf):
    """How near the knowledge base comes to every document of the pool."""
    own = B.pool(spark, sf).select(F.col("d").alias("q"), F.col("dv").alias("qv"))
    best = knn.pairs(own, B.kb(spark, sf), B.BUDGET).groupBy("q").agg(F.max("sim").alias("best"))
    return best.agg(F.round(F.avg("best"), 6).alias("diversity"), F.round(F.min("best"), 6).alias("worst"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_INTEREST}, N AS (SELECT c, d, row_number() OVER (PARTITION BY c ORDER BY list_inner_product(cv, dv) DESC, d) AS n FROM CV, P) SELECT d, min(c)::BIGINT AS c FROM N WHERE n <= 20 GROUP BY d""")
def cur_candidates(spark, sf):
    """The 20 nearest documents of each interest, each for the first interest that has it."""
    own = interests(spark, sf).select(F.col("c").alias("q"), F.col("cv").alias("qv"))
    near = knn.nearest(own, B.pool(spark, sf), 20)
    return near.groupBy("d").agg(F.min("q").alias("c"))


@query(f"""WITH {B.BASE}, U AS (SELECT q, q_label AS c, list_transform(qv, lambda x: x / greatest(sqrt(list_inner_product(qv, qv)), 1e-10)) AS u FROM Q),
D AS (SELECT a.q, a.c, b.c AS o, sum(1 - list_inner_product(a.u, b.u)) AS total, count(*) AS n FROM U a JOIN U b ON a.q <> b.q GROUP BY a.q, a.c, b.c),
S1 AS (SELECT q, c, max(CASE WHEN o = c THEN total / n END) AS own, min(CASE WHEN o <> c THEN total / n END) AS other FROM D GROUP BY q, c)
SELECT q, round(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(greatest(own, other), 1e-12) END, 6) AS silhouette FROM S1""")
def cur_silhouette(spark, sf):
    """Cosine silhouettes of the queries under their topics, from sums of vectors: no pairs of queries are made.

    The mean distance of a unit vector to a cluster is one less its product with the cluster's sum, over its size.
    """
    q = B.queries(spark, sf).select("q", F.col("q_label").alias("c"), V.unit("qv").alias("u"))
    sums = q.select("c", F.posexplode("u").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    sums = sums.groupBy(F.col("c").alias("o")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("own"), F.max("n").alias("n")).select("o", F.transform("own", lambda x: x["x"]).alias("sv"), "n")
    same = F.col("o") == F.col("c")
    both = q.crossJoin(F.broadcast(sums)).withColumn("others", F.col("n") - same.cast("int"))  # a row a topic
    far = F.when(F.col("others") > 0, (F.col("others") - (V.dot("u", "sv") - F.when(same, V.dot("u", "u")).otherwise(0.0))) / F.col("others"))
    own = both.withColumn("far", far).groupBy("q").agg(F.max(F.when(same, F.col("far"))).alias("own"), F.min(F.when(~same, F.col("far"))).alias("other"))
    score = (F.col("other") - F.col("own")) / F.greatest(F.col("own"), F.col("other"), F.lit(1e-12))
    return own.select("q", V.rounded(F.when(F.col("own").isNull() | F.col("other").isNull(), 0.0).otherwise(score)).alias("silhouette"))


@query(f"""WITH {_INTEREST}, F1X AS (SELECT q, list(round(list_inner_product(qv, cv), 6) ORDER BY c) AS sims FROM Q, CV GROUP BY q), T AS (SELECT q, list(round(sim, 6) ORDER BY rank) AS best FROM KR WHERE rank <= 10 GROUP BY q)
SELECT q, list_concat(sims, best) AS features FROM F1X JOIN T USING (q)""")
def drf_features(spark, sf):
    """Features of a query: its similarity to each interest, then those of its ten best documents."""
    q = B.queries(spark, sf)
    sims = q.select("q", "qv").crossJoin(F.broadcast(interests(spark, sf))).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("c", V.rounded(V.dot("qv", "cv")).alias("s")))).alias("own"))  # a row a topic
    best = knn.top(B.served(spark, sf), 10).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", V.rounded("sim").alias("s")))).alias("top"))
    return sims.join(best, "q").select("q", F.concat(F.transform("own", lambda x: x["s"]), F.transform("top", lambda x: x["s"])).alias("features"))


def _profile(rows: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(rows, float)
    return x.mean(axis=0), np.cov(x, rowvar=False)


@query()
def drf_windows(spark, sf):
    """Drift of each window's features from the first three windows': distance, a threshold from 200 resampled windows, and the decision.

    Features of a window are a row a query; the threshold is the 95th percentile by sorted index.
    """
    f = drf_features(spark, sf).join(B.queries(spark, sf).select("q", "window_idx"), "q")
    gap = {r.window_idx: 1 - r.g for r in B.served(spark, sf).groupBy("window_idx", "q").agg(F.max("sim").alias("m")).groupBy("window_idx").agg(F.avg("m").alias("g")).collect()}
    rows: dict[int, list] = {}
    for r in f.orderBy("window_idx", "q").toLocalIterator():  # a window at a time
        rows.setdefault(r.window_idx, []).append(r.features)
    first = sorted(rows)[:3]
    base = [x for w in first for x in rows[w]]
    if len(base) < 5:
        return spark.createDataFrame([], "window_idx long, distance double, threshold double, drifted boolean, action string")
    mean, cov = _profile(base)
    rng = np.random.default_rng(42)
    drawn = sorted(fold.frechet(mean, cov, *_profile([base[i] for i in rng.integers(0, len(base), B.WINDOW)])) for _ in range(200))
    limit = drawn[min(len(drawn) * 95 // 100, len(drawn) - 1)]
    found = [(w, fold.frechet(mean, cov, *_profile(x)) if len(x) > 1 else 0.0) for w, x in sorted(rows.items())]
    actions = fold.decide([(d > limit, gap[w]) for w, d in found])
    return spark.createDataFrame([(w, round(d, 6), round(limit, 6), d > limit, a) for (w, d), a in zip(found, actions, strict=True)], "window_idx long, distance double, threshold double, drifted boolean, action string")


@query()
def cur_recurate(spark, sf):
    """One step towards the ideal knowledge base: candidates of the interests are chosen greedily by weighted coverage, and at most a fifth changes."""
    own = interests(spark, sf).orderBy("c").collect()  # a row a topic
    kb = {r.d: np.asarray(r.dv, float) for r in B.kb(spark, sf).collect()}
    cand = {r.d: np.asarray(r.dv, float) for r in B.pool(spark, sf).join(cur_candidates(spark, sf), "d").collect()}  # twenty a topic
    docs = kb | cand
    ids = sorted(docs)
    sims, weights = np.array([r.cv for r in own], float) @ np.array([docs[d] for d in ids]).T, np.array([r.alpha for r in own])
    ideal = [ids[i] for i in fold.greedy_cover(sims, weights, B.BUDGET)]
    worth = dict(zip(ids, (weights @ np.maximum(sims, 0)).tolist(), strict=True))
    added, removed = fold.recurate(sorted(kb), ideal, worth, worth, 0.2)
    return spark.createDataFrame([(i + 1, a, r) for i, (a, r) in enumerate(zip(added, removed, strict=False))], "i long, added long, removed long")


@query()
def cur_interests(spark, sf):
    """Interests of each window found by clustering: the number with the best silhouette, and their weights."""
    import pandas as pd

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("q")
        x = np.array(own["u"].tolist(), float)
        k, _, weights = fold.best_k(x)
        return pd.DataFrame({"window_idx": own["window_idx"].iloc[0], "k": k, "c": range(len(weights)), "weight": np.round(weights, 6)})

    q = B.queries(spark, sf).select("window_idx", "q", V.unit("qv").alias("u"))
    return q.groupBy("window_idx").applyInPandas(run, "window_idx long, k long, c long, weight double")


@query()
def str_diverse_kb(spark, sf):
    """A diverse first knowledge base: within each topic the documents that are farthest from each other, by equal shares."""
    import pandas as pd

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("d")
        at = fold.farthest(np.array(own["u"].tolist(), float), 10)
        return pd.DataFrame({"label": own["label"].iloc[0], "n": range(len(at)), "d": own["d"].to_numpy()[at]})

    p = B.pool(spark, sf).select("label", "d", V.unit("dv").alias("u"))
    spread = p.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit("div|"), F.col("d").cast("string"))), "d"))).where("n <= 500").drop("n")  # the greedy choice is for small sets
    return spread.groupBy("label").applyInPandas(run, "label int, n long, d long")


@query(f"""WITH {B.BASE}, E AS (SELECT DISTINCT seq // 50 AS epoch FROM Q), K AS (SELECT epoch, d, row_number() OVER (PARTITION BY epoch ORDER BY md5('rand|' || epoch || '|' || d), d) AS n FROM E, P) SELECT epoch, d FROM K WHERE n <= {B.BUDGET}""")
def str_random_kb(spark, sf):
    """A random knowledge base that is drawn anew every 50 queries."""
    epochs = B.queries(spark, sf).select(F.expr("seq div 50").alias("epoch")).distinct()
    key = F.md5(F.concat_ws("|", F.lit("rand"), F.col("epoch").cast("string"), F.col("d").cast("string")))
    drawn = B.pool(spark, sf).select("d").crossJoin(F.broadcast(epochs)).withColumn("key", key)  # a row an epoch
    order = Window.partitionBy("epoch").orderBy("key", "d")
    return drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= B.BUDGET).select("epoch", "d")


@query(f"""WITH {B.BASE}, F0 AS (SELECT q, q_label FROM Q JOIN F1 USING (q) WHERE best < {B.HIT}), N AS (SELECT R.q, R.d, R.sim, row_number() OVER (PARTITION BY R.q ORDER BY R.rank) AS n FROM R JOIN F0 USING (q) WHERE rank <= 5)
SELECT q, d, CASE WHEN d IN (SELECT d FROM KB) THEN 'held' ELSE 'added' END AS state FROM N""")
def adp_fact_fill(spark, sf):
    """Queries that the knowledge base answers badly take in the pool's five best documents."""
    weak = B.served(spark, sf).groupBy("q").agg(F.max("sim").alias("best")).where(F.col("best") < B.HIT).select("q")
    near = knn.nearest(B.queries(spark, sf).join(weak, "q", "left_semi"), B.pool(spark, sf), 5)
    held = B.kb(spark, sf).select("d", F.lit("held").alias("state"))
    return near.join(F.broadcast(held), "d", "left").select("q", "d", F.coalesce("state", F.lit("added")).alias("state"))


@query(f"""WITH {B.BASE}, M AS (SELECT * FROM KR WHERE rank <= 3), N AS (SELECT M.q, P.d, list_inner_product(KB.dv, P.dv) AS sim, M.rank FROM M JOIN KB ON M.d = KB.d, P WHERE P.d <> M.d), B1 AS (SELECT q, rank, arg_max(d, (sim, -d)) AS d FROM N GROUP BY q, rank)
SELECT q, rank::INT AS rank, d FROM B1""")
def adp_memory_docs(spark, sf):
    """The pool document nearest to each of a query's three best records, other than the record itself."""
    kb = B.kb(spark, sf)
    own = knn.nearest(kb.select(F.col("d").alias("q"), F.col("dv").alias("qv")), B.pool(spark, sf), 2).where("q <> d").withColumnRenamed("q", "r")
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy("rank"))).where("n = 1").select("r", F.col("d").alias("found"))
    top = knn.top(B.served(spark, sf), 3).select("q", "rank", F.col("d").alias("r"))
    return top.join(F.broadcast(own), "r").select("q", "rank", F.col("found").alias("d"))


@query(f"""WITH {B.BASE}, L AS (SELECT a.q, list(b.seq ORDER BY b.seq) AS seqs, count(*) AS n FROM Q a JOIN Q b ON b.seq BETWEEN a.seq - 49 AND a.seq GROUP BY a.q) SELECT q, n, seqs[1] AS first FROM L""")
def leg_recent_queries(spark, sf):
    """The last 50 queries at each query, which gold feedback compares documents with; one pass in the order of the stream."""
    q = B.queries(spark, sf).select("q", "seq", F.expr("seq div 50").alias("part"))
    # a row stands in its own part and in the next, so that no task needs more than two
    both = q.withColumn("at", F.explode(F.array("part", F.col("part") + 1)))
    order = Window.partitionBy("at").orderBy("seq").rangeBetween(-49, 0)
    own = both.withColumn("n", F.count(F.lit(1)).over(order)).withColumn("first", F.min("seq").over(order))
    return own.where("at = part").select("q", "n", "first")


@query(f"WITH {B.BASE}, N AS (SELECT P.d, max(list_inner_product(P.dv, KB.dv)) AS near FROM P, KB WHERE P.d NOT IN (SELECT d FROM KB) GROUP BY P.d) SELECT d, round(near, 6) AS near FROM N WHERE near <= 0.35::DOUBLE")
def flt_near_duplicates(spark, sf):
    """Documents that may come in: none that is too like a resident."""
    own = B.kb(spark, sf)
    rest = B.pool(spark, sf).join(F.broadcast(own.select("d")), "d", "left_anti").select(F.col("d").alias("q"), F.col("dv").alias("qv"))
    return knn.pairs(rest, own, B.BUDGET).groupBy("q").agg(F.max("sim").alias("near")).where("near <= 0.35D").select(F.col("q").alias("d"), F.round("near", 6).alias("near"))


@query(f"WITH {B.BASE} SELECT (SELECT count(*) FROM KB) AS kb_size, (SELECT count(*) FROM P) AS pool_size, (SELECT count(DISTINCT label) FROM KB) AS topics, (SELECT count(*) FROM KB WHERE label = 0) AS first_topic, (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM P) + (SELECT count(*) FROM Q) AS consistent")
def agg_kb_counters(spark, sf):
    """Counters of a knowledge base, and whether the index has as many rows as its table."""
    kb = B.kb(spark, sf).agg(F.count(F.lit(1)).alias("kb_size"), F.countDistinct("label").alias("topics"), F.count_if(F.col("label") == 0).alias("first_topic"))
    pool, asked, all_ = (df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((B.pool(spark, sf), "pool_size"), (B.queries(spark, sf), "asked"), (read(spark, sf, "embeddings"), "rows")))
    own = kb.crossJoin(pool).crossJoin(asked).crossJoin(all_)  # a row each
    return own.select("kb_size", "pool_size", "topics", "first_topic", (F.col("rows") == F.col("pool_size") + F.col("asked")).alias("consistent"))


@query(f"""WITH {B.BASE}, M AS (SELECT q, list_transform(range(1, len(qv) + 1), lambda i: (qv[i] + dv[i]) / 2) AS mv FROM Q JOIN (SELECT q, d FROM R WHERE rank = 1) USING (q) JOIN P USING (d)) SELECT q, round(list_inner_product(mv, mv), 6) AS square, round(mv[1], 6) AS first FROM M""")
def vec_mean_pool(spark, sf):
    """A query's vector and that of its sub-question, here its nearest document, as one mean."""
    near = B.fetched(spark, sf, 1).select("q", "d").join(B.pool(spark, sf).select("d", "dv"), "d")
    mean = F.zip_with("qv", "dv", lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    own = B.queries(spark, sf).join(near, "q").select("q", mean.alias("mv"))
    return own.select("q", F.round(V.dot("mv", "mv"), 6).alias("square"), V.rounded(F.get("mv", F.lit(0))).alias("first"))


@query(f"""WITH {B.BASE}, E AS (SELECT q, d, sim, 1 AS l FROM KR WHERE rank <= 5 UNION ALL SELECT q, d, sim * 0.9::DOUBLE, 2 FROM R WHERE rank <= 5), M AS (SELECT q, d, max(sim) AS score FROM E GROUP BY q, d), N AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM M)
SELECT q, d, rank::INT AS rank, round(score, 6) AS score FROM N WHERE rank <= 5""")
def set_best_score(spark, sf):
    """Results of several queries for one question: of a document found twice the better score, then the best five."""
    kb = knn.top(B.served(spark, sf), 5).select("q", "d", F.col("sim").alias("score"))
    pool = B.fetched(spark, sf, 5).select("q", "d", (F.col("sim") * 0.9).alias("score"))
    best = kb.unionByName(pool).groupBy("q", "d").agg(F.max("score").alias("score"))
    return knn.top(best, 5, score="score").select("q", "d", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {B.BASE}, T AS (SELECT q, d, sim, rank FROM KR WHERE rank <= 10), S2 AS (SELECT T.q, T.d, sim, (Q.q_label = KB.label)::INT::DOUBLE AS rr FROM T JOIN Q USING (q) JOIN KB USING (d)), N AS (SELECT *, 0.5::DOUBLE * rr + 0.5::DOUBLE * sim AS score FROM S2 WHERE 0.5::DOUBLE * rr + 0.5::DOUBLE * sim >= 0.1::DOUBLE)
SELECT q, d, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM N) WHERE rank <= 3""")
def ret_rerank(spark, sf):
    """Recall, rerank by an injected scorer (here: the same topic), threshold, and the best three by both scores."""
    own = knn.top(B.served(spark, sf), 10).select("q", "q_label", "d", "label", "sim")
    scored = R.rerank(own, (F.col("q_label") == F.col("label")).cast("double"), "sim", least=0.1)
    return knn.top(scored, 3, score="score").select("q", "d", "rank", F.round("score", 6).alias("score"))
