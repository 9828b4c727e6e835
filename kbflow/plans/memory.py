"""Question memory, editable facts and topic clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbflow.functions.vectors import dot
from kbflow.operators import knn
from kbflow.operators.fold import cluster_store
from kbflow.plans import vectors as B
from kbflow.plans.register import query, read


@query(f"""WITH {B.BASE}, M AS (SELECT q, max(sim) AS best, arg_max(d, (sim, -d)) AS d FROM S GROUP BY q) SELECT q, CASE WHEN best >= 0.36::DOUBLE THEN 'reuse' WHEN best >= {B.HIT} THEN 'reference' ELSE 'generate' END AS route, d, round(best, 6) AS best FROM M""")
def mem_route(spark, sf):
    best = B.served(spark, sf).groupBy("q").agg(F.max(F.struct("sim", (-F.col("d")).alias("n"))).alias("b"))
    sim = F.col("b.sim")
    return best.select("q", F.when(sim >= 0.36, "reuse").when(sim >= B.HIT, "reference").otherwise("generate").alias("route"), (-F.col("b.n")).alias("d"), F.round(sim, 6).alias("best"))


@query("SELECT doc_id, CASE WHEN coalesce(quality, 0.5) >= 0.6 THEN 'high' ELSE 'low' END AS store, coalesce(quality::DOUBLE, 0.5::DOUBLE) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def mem_store(spark, sf):
    """Records by their score, one half where it is unknown."""
    d = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    score = F.coalesce(F.col("quality").cast("double"), F.lit(0.5))
    return d.select("doc_id", F.when(score >= 0.6, "high").otherwise("low").alias("store"), score.alias("score"))


@query(f"""WITH {B.BASE}, T AS (SELECT a.q, a.seq, b.q AS earlier, list_inner_product(a.qv, b.qv) AS sim FROM Q a JOIN Q b ON b.seq < a.seq), N AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, earlier) AS n FROM T)
SELECT q, earlier, round(sim, 6) AS sim, sim >= {B.HIT} AS reused FROM N WHERE n = 1""")
def mem_history(spark, sf):
    """The nearest of the queries that came before: an as-of search, a block of earlier queries against the later ones."""
    q = B.queries(spark, sf).select("q", "seq", "qv")
    own = q.join(q.select(F.col("q").alias("earlier"), F.col("seq").alias("at"), F.col("qv").alias("dv")), F.col("at") < F.col("seq")).withColumn("sim", dot("qv", "dv"))
    best = knn.top(own.select("q", "earlier", "sim"), 1, tie="earlier")
    return best.select("q", "earlier", F.round("sim", 6).alias("sim"), (F.col("sim") >= B.HIT).alias("reused"))


@query("""WITH H AS (SELECT user_id, list(strftime(ts, '%Y-%m-%d') || '=' || (event_type <> 'error')::VARCHAR ORDER BY ts, event_id) AS h, count(*)::INT AS n, arg_max(event_type <> 'error', (ts, event_id)) AS now FROM events GROUP BY user_id)
SELECT user_id, n, now, array_to_string(h, ', ') AS history FROM H""")
def fct_history(spark, sf):
    """A fact's history, rendered in order, and whether it holds now."""
    e = read(spark, sf, "events")
    own = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("event_type") != "error").alias("truth")))).alias("h"))
    shown = F.transform("h", lambda x: F.concat(F.date_format(x["ts"], "yyyy-MM-dd"), F.lit("="), x["truth"].cast("string")))
    return own.select("user_id", F.size("h").alias("n"), F.element_at("h", -1)["truth"].alias("now"), F.array_join(shown, ", ").alias("history"))


@query("""WITH E AS (SELECT user_id AS fact, event_id AS pos, CASE event_type WHEN 'error' THEN 'make_false' WHEN 'purchase' THEN 'rewrite' WHEN 'signup' THEN 'remove' ELSE 'reinforce' END AS op FROM events),
L AS (SELECT *, max(CASE WHEN op = 'remove' THEN pos END) OVER (PARTITION BY fact) AS gone FROM E)
SELECT fact, count(*) AS n, arg_max(op <> 'make_false', pos) AS truth, sum((op = 'rewrite')::INT)::BIGINT AS rewrites FROM L WHERE gone IS NULL OR pos > gone GROUP BY fact""")
def fct_edits(spark, sf):
    """Facts after a log of edits: what came before a removal is gone, the last edit says whether the fact holds."""
    kind = F.when(F.col("event_type") == "error", "make_false").when(F.col("event_type") == "purchase", "rewrite").when(F.col("event_type") == "signup", "remove").otherwise("reinforce")
    e = read(spark, sf, "events").select(F.col("user_id").alias("fact"), F.col("event_id").alias("at"), kind.alias("op"))
    e = e.withColumn("gone", F.max(F.when(F.col("op") == "remove", F.col("at"))).over(Window.partitionBy("fact"))).where("gone IS NULL OR at > gone")
    return e.groupBy("fact").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.col("op") != "make_false", "at").alias("truth"), F.sum((F.col("op") == "rewrite").cast("int")).alias("rewrites"))


@query(f"""WITH {B.BASE}, C AS (SELECT label, count(*) AS n, round(avg(vec_id % 7), 6) AS heat FROM embeddings GROUP BY label), V AS (SELECT label FROM C ORDER BY heat, label LIMIT 3)
SELECT vec_id AS d, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7, vec_id % 11, vec_id) AS n, count(*) OVER (PARTITION BY label) AS size FROM embeddings WHERE label IN (SELECT label FROM V)) WHERE size <= 30 OR n <= size * 3 // 10""")
def tkb_evict(spark, sf):
    """The coldest clusters lose their documents: all of a small cluster, else the coldest three of ten, by last access and count."""
    e = read(spark, sf, "embeddings").select("vec_id", "label")
    cold = e.groupBy("label").agg(F.round(F.avg(F.col("vec_id") % 7), 6).alias("heat")).orderBy("heat", "label").limit(3)
    own = Window.partitionBy("label")
    e = e.join(F.broadcast(cold.select("label")), "label", "left_semi").withColumn("n", F.row_number().over(own.orderBy(F.col("vec_id") % 7, F.col("vec_id") % 11, "vec_id"))).withColumn("size", F.count(F.lit(1)).over(own))
    return e.where("size <= 30 OR n <= size * 3 div 10").select(F.col("vec_id").alias("d"), "label")


@query("""WITH C AS (SELECT conv_id, count(*) AS n, avg(length(text)) AS mean FROM conversations GROUP BY conv_id) SELECT count(*) AS clusters, sum(n)::BIGINT AS records, max(n) AS largest, round(avg(n), 6) AS mean_size, round(avg(mean), 4) AS mean_score FROM C""")
def agg_cluster_stats(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean"))
    return c.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("records"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.avg("mean"), 4).alias("mean_score"))


@query()
def mem_clusters(spark, sf):
    """Each topic's records in order: join the nearest cluster, replace a near-equal record of a lower score, or begin a cluster."""
    e = read(spark, sf, "embeddings").select(F.col("label").alias("topic"), F.col("vec_id").alias("seq"), F.col("embedding").alias("v"), ((F.col("vec_id") % 10) / 10.0).alias("score"))
    return cluster_store(e, join=0.2, same=0.35)
