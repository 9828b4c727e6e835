"""Metrics of retrieval, coverage, turnover and drift, by query, by window and over runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbflow.functions import text as T
from kbflow.operators import knn, metrics
from kbflow.plans import vectors as B
from kbflow.plans.register import query, read


@query(f"""WITH {B.BASE}, H AS (SELECT Q.window_idx, Q.q, avg(CASE WHEN KR.rank <= {B.K} THEN 1.0::DOUBLE ELSE 0 END) AS r FROM Q JOIN G USING (q) LEFT JOIN KR ON KR.q = Q.q AND KR.d = G.d GROUP BY Q.window_idx, Q.q)
SELECT window_idx, count(*) AS n_queries, round(avg(r), 6) AS recall FROM H GROUP BY window_idx""")
def windowed_recall(spark, sf):
    """Recall@5 of each window of queries against a static knowledge base."""
    found = knn.top(B.served(spark, sf), B.K).select("q", "d")
    return metrics.windowed(metrics.recall(B.gold(spark, sf), found), B.queries(spark, sf).select("q", "window_idx"))


@query(f"""WITH {B.BASE}, X AS (SELECT G.q, G.d, KR.rank FROM G LEFT JOIN KR ON KR.q = G.q AND KR.d = G.d AND KR.rank <= 10)
SELECT q, round(avg((rank IS NOT NULL)::INT), 6) AS recall, round(sum((rank IS NOT NULL)::INT) / 10.0::DOUBLE, 6) AS precision, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr FROM X GROUP BY q""")
def agg_rank_metrics(spark, sf):
    found = knn.top(B.served(spark, sf), 10).select("q", "d", "rank")
    return metrics.by_query(B.gold(spark, sf), found, 10)


@query(f"WITH {B.BASE} SELECT Q.window_idx, round(1 - avg(best), 6) AS gap, count(*) AS n FROM Q JOIN F1 USING (q) GROUP BY Q.window_idx")
def agg_alignment_gap(spark, sf):
    best = B.served(spark, sf).groupBy("window_idx", "q").agg(F.max("sim").alias("best"))
    return best.groupBy("window_idx").agg(F.round(1 - F.avg("best"), 6).alias("gap"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.BASE} SELECT d, round(avg(sim), 6) AS usefulness, round(max(sim), 6) AS best, sum((sim >= {B.HIT})::INT)::BIGINT AS hits FROM S GROUP BY d")
def agg_usefulness(spark, sf):
    return B.served(spark, sf).groupBy("d").agg(F.round(F.avg("sim"), 6).alias("usefulness"), F.round(F.max("sim"), 6).alias("best"), F.sum((F.col("sim") >= B.HIT).cast("int")).alias("hits"))


@query(f"""WITH {B.BASE}, W AS (SELECT DISTINCT window_idx, d FROM Q JOIN G USING (q)), N AS (SELECT d, min(window_idx) AS window_idx FROM W GROUP BY d),
C AS (SELECT window_idx, count(*) AS gold, sum((d IN (SELECT d FROM KB))::INT)::BIGINT AS covered FROM W GROUP BY window_idx), M AS (SELECT window_idx, count(*) AS new, sum((d IN (SELECT d FROM KB))::INT)::BIGINT AS new_covered FROM N GROUP BY window_idx)
SELECT window_idx, round(covered / gold::DOUBLE, 6) AS coverage, round(sum(coalesce(new_covered, 0)) OVER o / (sum(coalesce(new, 0)) OVER o)::DOUBLE, 6) AS cumulative FROM C LEFT JOIN M USING (window_idx) WINDOW o AS (ORDER BY window_idx)""")
def agg_coverage(spark, sf):
    gold = B.gold(spark, sf).join(B.queries(spark, sf).select("q", "window_idx"), "q").select("window_idx", "d").distinct()
    return metrics.coverage(gold, B.kb(spark, sf).select("d"))


@query("""WITH W AS (SELECT DISTINCT l_orderkey // 100 AS w, l_partkey AS d FROM lineitem), A AS (SELECT w, count(*) AS n FROM W GROUP BY w), I AS (SELECT a.w, count(*) AS i FROM W a JOIN W b ON a.d = b.d AND b.w = a.w - 1 GROUP BY a.w)
SELECT A.w AS version, round(1 - coalesce(i, 0) / (A.n + p.n - coalesce(i, 0))::DOUBLE, 6) AS turnover FROM A JOIN A p ON p.w = A.w - 1 LEFT JOIN I ON I.w = A.w""")
def agg_turnover(spark, sf):
    """Symmetric difference over union of consecutive versions."""
    own = read(spark, sf, "lineitem").select(F.expr("l_orderkey div 100").alias("version"), F.col("l_partkey").alias("d")).distinct()
    return metrics.turnover(own)


@query(r"""WITH A AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w, lower(trim(text)) AS t FROM conversations WHERE role = 'user'),
B AS (SELECT conv_id, turn - 1 AS turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w, lower(trim(text)) AS t FROM conversations WHERE role = 'assistant'),
N AS (SELECT conv_id, turn, A.t = B.t AS em, len(list_intersect(A.w, B.w)) AS c, len(A.w) AS a, len(B.w) AS b FROM A JOIN B USING (conv_id, turn))
SELECT conv_id, turn, em, round(CASE WHEN c = 0 THEN 0 ELSE 2.0::DOUBLE * c / (a + b) END, 6) AS f1 FROM N""")
def agg_answer_f1(spark, sf):
    """Exact match and F1 over sets of tokens, of a user's turn and the answer to it."""
    c = read(spark, sf, "conversations")
    own = lambda role, turn, w, t: c.where(F.col("role") == role).select("conv_id", (F.col("turn") + turn).alias("turn"), F.array_distinct(T.tokens(F.col("text"))).alias(w), F.lower(F.trim("text")).alias(t))
    both = own("user", 0, "a", "ta").join(own("assistant", -1, "b", "tb"), ["conv_id", "turn"])
    common = F.size(F.array_intersect("a", "b"))
    return both.select("conv_id", "turn", (F.col("ta") == F.col("tb")).alias("em"), F.round(F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size("a") + F.size("b"))), 6).alias("f1"))


_DAYS = "D AS (SELECT ts::DATE AS day, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2), H AS (SELECT day, topic, n / sum(n) OVER (PARTITION BY day)::DOUBLE AS p FROM D)"


@query(f"""WITH {_DAYS}, L AS (SELECT DISTINCT day FROM H), T AS (SELECT DISTINCT topic FROM H), X AS (SELECT L.day, T.topic, coalesce(p, 0) + 1e-12 AS p FROM L CROSS JOIN T LEFT JOIN H USING (day, topic)), Y AS (SELECT *, lag(p) OVER (PARTITION BY topic ORDER BY day) AS q FROM X)
SELECT day, round(0.5::DOUBLE * sum(p * ln(p / ((p + q) / 2))) + 0.5::DOUBLE * sum(q * ln(q / ((p + q) / 2))), 6) AS jsd FROM Y WHERE q IS NOT NULL GROUP BY day""")
def mth_jsd(spark, sf):
    d = read(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.drift(d)


@query("""WITH M AS (SELECT date_trunc('month', ts)::DATE AS month, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2) SELECT month, topic, n, round(n / sum(n) OVER (PARTITION BY month)::DOUBLE, 6) AS share FROM M""")
def agg_monthly_shares(spark, sf):
    m = read(spark, sf, "events").groupBy(F.to_date(F.date_trunc("month", "ts")).alias("month"), F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return m.select("month", "topic", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("month")), 6).alias("share"))


_HOURS = "V AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1), I AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, v FROM V)"


def _hours(spark, sf):
    v = read(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    return v.select((F.row_number().over(Window.orderBy("h")) - 1).cast("long").alias("i"), "v")


@query(f"WITH {_HOURS} SELECT i // 10 AS block, count(*) AS n, round(avg(v), 6) AS mean FROM I GROUP BY 1")
def win_blocks(spark, sf):
    return _hours(spark, sf).groupBy(F.expr("i div 10").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query(f"""WITH RECURSIVE {_HOURS}, R AS (SELECT i, v, v AS ema, 0.0::DOUBLE AS mad FROM I WHERE i = 0 UNION ALL
SELECT I.i, I.v, 0.85::DOUBLE * ema + 0.15::DOUBLE * I.v, 0.85::DOUBLE * mad + 0.15::DOUBLE * abs(I.v - (0.85::DOUBLE * ema + 0.15::DOUBLE * I.v)) FROM R JOIN I ON I.i = R.i + 1)
SELECT i, round(ema, 5) AS ema, round(mad, 5) AS mad FROM R""")
def win_ema(spark, sf):
    """Running mean and running deviation; the deviation is taken from the mean after its step."""
    return metrics.running(_hours(spark, sf), 0.85)


@query(f"""WITH {B.BASE}, D AS (SELECT d, window_idx, max(sim) AS best FROM S GROUP BY d, window_idx), N AS (SELECT max(window_idx) AS w FROM Q) SELECT d, round(max(best * pow(0.8::DOUBLE, w - window_idx)), 6) AS heat FROM D, N GROUP BY d""")
def win_decayed_max(spark, sf):
    own = B.served(spark, sf).groupBy("d", "window_idx").agg(F.max("sim").alias("best"))
    last = B.queries(spark, sf).agg(F.max("window_idx").alias("w"))
    return own.crossJoin(F.broadcast(last)).groupBy("d").agg(F.round(F.max(F.col("best") * F.pow(F.lit(0.8), F.col("w") - F.col("window_idx"))), 6).alias("heat"))


@query("""WITH U AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), I AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, bad ORDER BY n) AS island FROM U)
SELECT user_id, max(len)::BIGINT AS longest, count(*) AS runs FROM (SELECT user_id, island, count(*) AS len FROM I WHERE bad GROUP BY user_id, island) GROUP BY user_id""")
def win_consecutive(spark, sf):
    """Runs of drifted steps of each key."""
    e = read(spark, sf, "events").withColumn("bad", F.col("event_type") == "error").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = e.where("bad").withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("user_id").orderBy("n")))
    return e.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("len")).groupBy("user_id").agg(F.max("len").alias("longest"), F.count(F.lit(1)).alias("runs"))


@query(f"""WITH {_HOURS}, B AS (SELECT i // 10 AS w, avg(v) AS m FROM I GROUP BY 1), L AS (SELECT w, m - lag(m) OVER (ORDER BY w) AS up FROM B), P AS (SELECT max(m) AS peak, min(m) AS low, arg_min(w, (m, w)) AS trough FROM B)
SELECT round(sum(greatest(up, 0)) / count(*), 6) AS precision, (SELECT min(w) - any_value(trough) FROM B, P WHERE w >= trough AND m >= 0.9::DOUBLE * peak) AS adaptation, (SELECT round(avg(m), 6) FROM B WHERE w < (SELECT (max(w) + 1) // 2 FROM B)) AS first_half,
(SELECT round(avg(m), 6) FROM B WHERE w >= (SELECT (max(w) + 1) // 2 FROM B)) AS second_half FROM L""")
def agg_adaptation(spark, sf):
    """Gains between windows for each update, windows from the trough back to nine tenths of the peak, and means of both halves."""
    blocks = _hours(spark, sf).groupBy(F.expr("i div 10").alias("w")).agg(F.avg("v").alias("m"))
    return metrics.adaptation(blocks)


@query("""WITH O AS (SELECT l_shipdate::DATE AS day, avg(l_discount) AS x, avg(l_tax) AS y, avg(l_quantity) AS z FROM lineitem GROUP BY 1) SELECT round(covar_samp(x, y), 6) AS xy, round(covar_samp(x, z), 6) AS xz, round(covar_samp(y, z), 6) AS yz, round(var_samp(x) + 1e-5, 6) AS xx, round(avg(z), 4) AS mz FROM O""")
def agg_covariance(spark, sf):
    o = read(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"), F.avg("l_quantity").alias("z"))
    return o.agg(F.round(F.covar_samp("x", "y"), 6).alias("xy"), F.round(F.covar_samp("x", "z"), 6).alias("xz"), F.round(F.covar_samp("y", "z"), 6).alias("yz"), F.round(F.var_samp("x") + 1e-5, 6).alias("xx"), F.round(F.avg("z"), 4).alias("mz"))


@query("SELECT user_id, list_sort(list(value))[least((count(*) * 95 // 100), count(*) - 1) + 1] AS p95 FROM events GROUP BY user_id")
def agg_percentile(spark, sf):
    """The value at position int(n * 0.95) of the sorted ones, the last at most."""
    own = Window.partitionBy("user_id")
    e = read(spark, sf, "events").select("user_id", "value", F.row_number().over(own.orderBy("value", "event_id")).alias("n"), F.count(F.lit(1)).over(own).alias("of"))
    return e.where("n = least(of * 95 div 100, of - 1) + 1").select("user_id", F.col("value").alias("p95"))


@query("""WITH A AS (SELECT c_mktsegment AS method, c_nationkey AS scenario, avg(c_acctbal) AS score FROM customer GROUP BY 1, 2), K AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY score DESC) AS r FROM A)
SELECT method, round(avg(score), 6) AS average, sum((r = 1)::INT)::BIGINT AS wins, round(avg(r), 6) AS mean_rank FROM K GROUP BY method""")
def agg_scenarios(spark, sf):
    a = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").alias("scenario")).agg(F.avg("c_acctbal").alias("score"))
    a = a.withColumn("r", F.rank().over(Window.partitionBy("scenario").orderBy(F.col("score").desc())))
    return a.groupBy("method").agg(F.round(F.avg("score"), 6).alias("average"), F.sum((F.col("r") == 1).cast("int")).alias("wins"), F.round(F.avg("r"), 6).alias("mean_rank"))


@query("SELECT source, arg_min(doc_id, doc_id) AS first_id, arg_max(doc_id, (length(text), -doc_id)) AS longest_id, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY source")
def agg_first_longest(spark, sf):
    d = read(spark, sf, "documents").select("source", "doc_id", F.length("text").alias("n"), F.md5("text").alias("h"))
    return d.groupBy("source").agg(F.min("doc_id").alias("first_id"), F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("longest_id"), F.countDistinct("h").alias("texts"))
