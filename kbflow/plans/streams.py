"""Streams: construction with drift, pools and budgets, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbflow.operators import stream as S
from kbflow.plans import vectors as B
from kbflow.plans.register import query, read


@query("SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def srt_sample(spark, sf):
    return S.sample(read(spark, sf, "documents").where("lang = 'en'").select("doc_id"), 100, 7, "doc_id")


@query("SELECT p_partkey, p_size <= 3 AS is_gold FROM part ORDER BY (p_size <= 3)::INT DESC, md5('cap|' || p_partkey), p_partkey LIMIT 150")
def srt_cap_gold(spark, sf):
    """A pool cut to a size that keeps all gold documents before others."""
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_size") <= 3).alias("is_gold"))
    return p.orderBy(F.col("is_gold").desc(), S.order_key("cap", "p_partkey"), "p_partkey").limit(150)


@query(f"""WITH {B.BASE}, W AS (SELECT w AS window_idx, round_even(CASE WHEN w < 5 THEN 0.97::DOUBLE ELSE 0.03::DOUBLE END * 10, 0)::INT AS heads FROM range(10) r(w)), SL AS (SELECT window_idx, p AS pos, p < heads AS is_head FROM W, range(10) r(p)),
T AS (SELECT *, row_number() OVER (PARTITION BY is_head ORDER BY window_idx, pos) - 1 AS turn FROM SL), D AS (SELECT q, q_label <= 2 AS is_head, row_number() OVER (PARTITION BY q_label <= 2 ORDER BY md5('42|' || q), q) - 1 AS n, count(*) OVER (PARTITION BY q_label <= 2) AS size FROM Q)
SELECT window_idx, pos::INT AS pos, q, T.is_head FROM T JOIN D ON T.is_head = D.is_head AND D.n = T.turn % D.size""")
def stm_sudden_drift(spark, sf):
    return S.drift(B.queries(spark, sf), 10, 10, F.col("q_label") <= 2)


@query("WITH S AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events) SELECT seq // 50 AS window_idx, event_type, count(*) AS n FROM S GROUP BY 1, 2")
def stm_count_windows(spark, sf):
    """A stream cut by count; positions follow from counts of each day before them, so no task numbers the whole stream."""
    from pyspark.sql import Window

    e = read(spark, sf, "events").select("event_id", "event_type", "ts", F.to_date("ts").alias("day"))
    days = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    seq = F.col("base") + F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")) - 1
    return e.join(before, "day").withColumn("seq", seq).groupBy(S.window_of("seq", 50).alias("window_idx"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, greatest(300, round_even(s_acctbal / 2 / 50, 0) * 50)::BIGINT AS budget FROM supplier")
def stm_budget(spark, sf):
    """The size of a knowledge base: half of a pool in steps of 50, 300 at least."""
    return read(spark, sf, "supplier").select("s_suppkey", F.greatest(F.lit(300), F.bround(F.col("s_acctbal") / 2 / 50) * 50).cast("long").alias("budget"))


@query("""WITH U AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'), A AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, 'q_' || substr(md5(question), 1, 8) AS query_id, length(answer) AS answer_chars FROM U LEFT JOIN A USING (conv_id, turn)""")
def stm_dialog_pairs(spark, sf):
    c = read(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", F.concat(F.lit("q_"), F.substring(F.md5("question"), 1, 8)).alias("query_id"), F.length("answer").cast("long").alias("answer_chars"))


@query("""WITH T AS (SELECT event_type AS topic, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 20) SELECT topic, n FROM T ORDER BY n DESC, topic LIMIT 3""")
def stm_topics(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20").orderBy(F.col("n").desc(), "topic").limit(3)


@query("""WITH R AS (SELECT o_custkey, min(year(o_orderdate)) AS first_year, count(*) AS n FROM orders GROUP BY o_custkey) SELECT first_year, count(*) AS customers, sum(n)::BIGINT AS orders FROM R GROUP BY first_year""")
def stm_first_rounds(spark, sf):
    """Queries by the round in which they first come."""
    r = read(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).cast("long").alias("first_year"), F.count(F.lit(1)).alias("n"))
    return r.groupBy("first_year").agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders"))


@query("""WITH C AS (SELECT n_nationkey AS topic, n_regionkey AS head FROM nation), D AS (SELECT c_custkey AS d, c_nationkey AS topic, round(c_acctbal, 2) AS affinity FROM customer), J AS (SELECT d, head, affinity FROM D JOIN C USING (topic))
SELECT d, head = 0 AS seeded FROM J ORDER BY (head = 0)::INT DESC, affinity DESC, d LIMIT 60""")
def stm_head_kb(spark, sf):
    """A first knowledge base of the head topics' documents, filled up by affinity."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("topic"), F.col("n_regionkey").alias("head"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("d"), F.col("c_nationkey").alias("topic"), F.round("c_acctbal", 2).alias("affinity"))
    own = c.join(n, "topic").select("d", (F.col("head") == 0).alias("seeded"), "affinity")
    return own.orderBy(F.col("seeded").desc(), F.col("affinity").desc(), "d").limit(60).select("d", "seeded")
