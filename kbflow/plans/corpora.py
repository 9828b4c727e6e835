"""Corpora, streams built from them, and what models return: scans, builders, parsers and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from kbflow.functions import chunking, models
from kbflow.functions import text as T
from kbflow.functions import vectors as V
from kbflow.operators import fold
from kbflow.operators import stream as S
from kbflow.plans import vectors as B
from kbflow.plans.projections import _RULES_SQL
from kbflow.plans.register import query, read


@query("SELECT lang AS config, count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL AND text <> '' AND lang IN ('en', 'de', 'fr') GROUP BY lang")
def src_configs(spark, sf):
    """Parts of a corpus read one by one, rows without the needed columns left out, as one table."""
    d = read(spark, sf, "documents")
    own = None
    for config in ("en", "de", "fr"):
        part = d.where((F.col("lang") == config) & F.col("text").isNotNull() & (F.col("text") != "")).select(F.lit(config).alias("config"), "source")
        own = part if own is None else own.unionByName(part)
    return own.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query("""WITH D AS (SELECT p_partkey AS d FROM part WHERE p_size <= 30), J AS (SELECT l_orderkey AS q, l_partkey AS d FROM lineitem WHERE l_linenumber >= 2 AND l_partkey IN (SELECT d FROM D))
SELECT q, array_to_string(list(DISTINCT d ORDER BY d), ',') AS gold FROM J GROUP BY q""")
def src_judged(spark, sf):
    """Queries with the documents that are judged relevant and present."""
    from kbflow.sources import corpora

    docs = read(spark, sf, "part").where("p_size <= 30").select(F.col("p_partkey").alias("doc_id"))
    line = read(spark, sf, "lineitem")
    qrels = line.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("relevance"))
    asked = line.select(F.col("l_orderkey").alias("query_id")).distinct().withColumn("text", F.lit(""))
    own = corpora.judged(docs, asked, qrels, 2)
    return own.select(F.col("query_id").alias("q"), F.array_join(F.transform("gold", lambda x: x.cast("string")), ",").alias("gold"))


@query("SELECT source AS title, arg_min(doc_id, doc_id) AS doc_id, arg_min(md5(text), doc_id) AS text_hash FROM documents WHERE lang = 'en' GROUP BY source")
def src_pool(spark, sf):
    """A pool: the first text of each title."""
    from kbflow.sources import corpora

    d = read(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")
    return corpora.pool(d).join(d.groupBy("title").agg(F.min("id").alias("doc_id")), "title").select("title", "doc_id", F.md5("text").alias("text_hash"))


@query(f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND {_RULES_SQL} = 'english'")
def src_chat_english(spark, sf):
    """Questions of a chat log that are in one language."""
    c = read(spark, sf, "conversations").where("role = 'user'")
    return c.where(T.first_rule(F.col("text")) == "english").select("conv_id", "turn")


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def src_json_round_trip(spark, sf):
    """Rows written as JSON and read again are the same."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    held = c.select(F.from_json(F.to_json(F.struct("*")), c.schema).alias("r")).select("r.*")
    return held.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("""WITH C AS (SELECT c_nationkey AS topic, c_custkey AS d FROM customer) SELECT topic, count(*) AS n, array_to_string(list(d ORDER BY d), ',') AS docs FROM C GROUP BY topic""")
def jon_topic_docs(spark, sf):
    own = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("c_custkey")).alias("d"))
    return own.select("topic", "n", F.array_join(F.transform("d", lambda x: x.cast("string")), ",").alias("docs"))


@query("""WITH K AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text), R AS (SELECT doc_id, text FROM documents WHERE lang = 'de') SELECT R.doc_id, K.first FROM R JOIN K USING (text)""")
def jon_back_by_text(spark, sf):
    """Rows that a model returned by their text alone, joined back to the first row with it: by a digest, the text then confirmed."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    first = d.groupBy("h", F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first"))
    own = d.where("lang = 'de'").select("doc_id", "h", F.sha2("text", 256).alias("digest"))
    return own.join(first, ["h", "digest"]).select("doc_id", "first")


@query("SELECT item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) AS entity FROM benchmark")
def ret_entities(spark, sf):
    """Named entities by an injected function, here spans of capitalised words."""
    return read(spark, sf, "benchmark").select("item_id", F.explode(models.capitalised(F.col("text"))).alias("entity"))


@query("""WITH E AS (SELECT user_id, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, label, n FROM E WHERE label NOT IN ('error', 'view')""")
def flt_labels(spark, sf):
    return read(spark, sf, "events").where(~F.col("event_type").isin("error", "view")).groupBy("user_id", F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH T AS (SELECT conv_id, turn, 'Facts:' || chr(10) || '1. ' || role || chr(10) || '- turn ' || turn || chr(10) || 'Rewrite: <<' || substr(text, 1, 40) || '>>' || chr(10) || '[1, 2, ' || turn || ']' AS out FROM conversations)
SELECT conv_id, turn, trim(regexp_extract(out, '<<((?s).*?)>>', 1)) AS rewrite, regexp_extract(out, '\[[0-9, ]+\]', 0) AS slice, turn::INT AS last FROM T""")
def prj_parsers(spark, sf):
    """Parsers of a model's answer: what stands between marks, and a slice that is a JSON array."""
    c = read(spark, sf, "conversations")
    out = F.concat(F.lit("Facts:\n1. "), "role", F.lit("\n- turn "), F.col("turn").cast("string"), F.lit("\nRewrite: <<"), F.substring("text", 1, 40), F.lit(">>\n[1, 2, "), F.col("turn").cast("string"), F.lit("]"))
    own = c.select("conv_id", "turn", out.alias("out"))
    part = F.regexp_extract("out", r"\[[0-9, ]+\]", 0)
    return own.select("conv_id", "turn", F.trim(F.regexp_extract("out", "(?s)<<(.*?)>>", 1)).alias("rewrite"), part.alias("slice"), F.element_at(F.from_json(part, "array<int>"), -1).alias("last"))


@query("""SELECT conv_id, turn, 'Question: ' || substr(text, 1, 60) || chr(10) || 'Answer in one sentence.' AS prompt, CASE WHEN length(text) < 40 THEN 'Sorry, that did not work: too short.' ELSE 'ok' END AS reply FROM conversations WHERE role = 'user'""")
def prj_prompts(spark, sf):
    """Prompts, and the reply that an error gets."""
    c = read(spark, sf, "conversations").where("role = 'user'")
    prompt = F.format_string("Question: %s\nAnswer in one sentence.", F.substring("text", 1, 60))
    return c.select("conv_id", "turn", prompt.alias("prompt"), F.when(F.length("text") < 40, F.format_string("Sorry, that did not work: %s.", F.lit("too short"))).otherwise("ok").alias("reply"))


@query()
def prj_separator_chunks(spark, sf):
    """Chunks that end at paragraphs, lines, sentences or words."""
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(chunking.chunks(F.col("text"))).alias("chunk_id", "chunk"))


_GRID = """G AS (SELECT seq, topic, exp(-(seq / 199.0::DOUBLE - (topic + 0.5::DOUBLE) / 5) * (seq / 199.0::DOUBLE - (topic + 0.5::DOUBLE) / 5) / (2 * 0.18::DOUBLE * 0.18::DOUBLE)) AS g FROM (SELECT unnest(range(200)) AS seq), (SELECT unnest(range(5)) AS topic)),
H AS (SELECT seq, topic, round(g / sum(g) OVER (PARTITION BY seq), 6) AS p FROM G), C AS (SELECT seq, topic, round(sum(p) OVER (PARTITION BY seq ORDER BY topic), 6) AS cum FROM H),
U AS (SELECT seq, ('0x' || substr(md5('draw|' || seq), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM (SELECT unnest(range(200)) AS seq))"""


@query(f"""WITH {_GRID}, T AS (SELECT U.seq, coalesce(min(CASE WHEN cum > u THEN topic END), 4) AS topic FROM U JOIN C USING (seq) GROUP BY U.seq), N AS (SELECT seq, topic, row_number() OVER (PARTITION BY topic ORDER BY seq) - 1 AS turn FROM T),
Q AS (SELECT doc_id, doc_id % 5 AS topic, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY doc_id % 5) AS size FROM documents)
SELECT seq::BIGINT AS seq, N.topic::INT AS topic, doc_id FROM N JOIN Q ON Q.topic = N.topic AND Q.n = N.turn % Q.size""")
def stm_scheduled(spark, sf):
    """A stream whose topics follow a schedule: drawn by a hash, and within a topic its queries in turn, again from the start when they run out."""
    share = S.schedules(spark, 200, 5).select("seq", "topic", "gradual")
    cum = share.withColumn("cum", F.round(F.sum("gradual").over(Window.partitionBy("seq").orderBy("topic")), 6))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("draw|"), F.col("seq").cast("string"))), 1, 7), 16, 10).cast("double") / 268435456.0
    drawn = cum.groupBy("seq").agg(F.coalesce(F.min(F.when(F.col("cum") > u, F.col("topic"))), F.lit(4)).alias("topic"))
    turns = drawn.withColumn("turn", F.row_number().over(Window.partitionBy("topic").orderBy("seq")) - 1)  # as many as the stream is long
    order = Window.partitionBy("topic")
    asked = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("topic"))
    asked = asked.withColumn("n", F.row_number().over(order.orderBy("doc_id")) - 1).withColumn("size", F.count(F.lit(1)).over(order))
    both = turns.join(asked, "topic").where("n = turn % size")
    return both.select(F.col("seq").cast("long").alias("seq"), "topic", "doc_id")


def _drift_sql(share: str) -> str:
    return f"""WITH {B.BASE}, W AS (SELECT w AS window_idx, round_even(({share}) * 10, 0)::INT AS heads FROM range(10) r(w)), SL AS (SELECT window_idx, p AS pos, p < heads AS is_head FROM W, range(10) r(p)),
T AS (SELECT *, row_number() OVER (PARTITION BY is_head ORDER BY window_idx, pos) - 1 AS turn FROM SL), D AS (SELECT q, q_label <= 2 AS is_head, row_number() OVER (PARTITION BY q_label <= 2 ORDER BY md5('42|' || q), q) - 1 AS n, count(*) OVER (PARTITION BY q_label <= 2) AS size FROM Q)
SELECT window_idx, pos::INT AS pos, q, T.is_head FROM T JOIN D ON T.is_head = D.is_head AND D.n = T.turn % D.size"""


@query(_drift_sql("CASE WHEN w < 5 THEN 0.97::DOUBLE ELSE 0.97::DOUBLE - 0.94::DOUBLE * (w - 4) / 5 END"))
def stm_gradual_drift(spark, sf):
    """Head queries give way to tail queries over the second half."""
    w = F.col("window_idx")
    return S.drift(B.queries(spark, sf), 10, 10, F.col("q_label") <= 2, share=F.when(w < 5, 0.97).otherwise(0.97 - 0.94 * (w - 4) / 5))


@query(_drift_sql("0.97::DOUBLE - 0.94::DOUBLE * w / 9"))
def stm_full_drift(spark, sf):
    """Head queries give way to tail queries over all windows."""
    return S.drift(B.queries(spark, sf), 10, 10, F.col("q_label") <= 2, share=0.97 - 0.94 * F.col("window_idx") / 9)


@query("SELECT p_partkey, 'doc' || lpad(p_partkey::VARCHAR, 8, '0') AS pool_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def stm_focus(spark, sf):
    """A pool cut to the documents that queries refer to."""
    used = read(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey")).distinct()
    own = read(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_semi")
    return own.select("p_partkey", F.concat(F.lit("doc"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("pool_id"))


@query("""WITH G AS (SELECT DISTINCT l_partkey AS d FROM lineitem WHERE l_linenumber = 7), N AS (SELECT p_partkey AS d FROM part WHERE p_partkey NOT IN (SELECT d FROM G) ORDER BY md5('fill|' || p_partkey), p_partkey LIMIT 100)
SELECT d, true AS is_gold FROM G UNION ALL SELECT d, false FROM N""")
def stm_distractors(spark, sf):
    """Gold documents and a hundred others that no query asks for."""
    gold = read(spark, sf, "lineitem").where("l_linenumber = 7").select(F.col("l_partkey").alias("d")).distinct()
    rest = read(spark, sf, "part").select(F.col("p_partkey").alias("d")).join(gold, "d", "left_anti")
    return gold.select("d", F.lit(True).alias("is_gold")).unionByName(S.sample(rest, 100, "fill", "d").select("d", F.lit(False).alias("is_gold")))


@query("""WITH C AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), K AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS r FROM C) SELECT label, n, r <= 3 AS is_head FROM K""")
def stm_head_tail(spark, sf):
    """Clusters by size: the three largest are the head."""
    c = read(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    head = c.orderBy(F.col("n").desc(), "label").limit(3).select("label", F.lit(True).alias("head"))
    return c.join(head, "label", "left").select("label", "n", F.coalesce("head", F.lit(False)).alias("is_head"))


@query()
def stm_walk(spark, sf):
    """A walk from nation to nation that share a region or customers' segments: a neighbour that was not seen yet, else the next nation."""
    n = read(spark, sf, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # a row a nation
    near = {a.n_nationkey: [b.n_nationkey for b in n if b.n_regionkey == a.n_regionkey and b != a] for a in n}
    return spark.createDataFrame(list(enumerate(fold.walk(near, len(n)))), "step long, node long")


@query("""WITH V AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1), I AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, v FROM V),
J AS (SELECT a.i, sum(b.v * exp(-(b.i - a.i) * (b.i - a.i) / 2.0::DOUBLE)) / sum(exp(-(b.i - a.i) * (b.i - a.i) / 2.0::DOUBLE)) AS s FROM I a JOIN I b ON b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY a.i) SELECT i, round(s, 6) AS smooth FROM J""")
def mth_smooth(spark, sf):
    """A series smoothed by a bell over five windows, and fewer at its ends."""
    from kbflow.plans.evaluation import _hours

    v = _hours(spark, sf)
    near = v.select(F.explode(F.sequence(F.col("i") - 2, F.col("i") + 2)).alias("at"), "i", "v").withColumn("w", F.exp(-(F.col("i") - F.col("at")) * (F.col("i") - F.col("at")) / 2.0))
    own = near.groupBy("at").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("s"))
    return own.join(v.select(F.col("i").alias("at")), "at", "left_semi").select(F.col("at").alias("i"), F.round("s", 6).alias("smooth"))


@query("""WITH E AS (SELECT user_id, avg(value) * CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END AS ms, count(*) AS n FROM events GROUP BY user_id, event_type) SELECT user_id, round(sum(ms * n) / sum(n), 3) AS latency FROM E GROUP BY user_id""")
def mth_latency(spark, sf):
    """Latency a query: cold searches cost five times a warm one."""
    e = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    ms = F.col("v") * F.when(F.col("event_type") == "purchase", 5).otherwise(1)
    return e.groupBy("user_id").agg(F.round(F.sum(ms * F.col("n")) / F.sum("n"), 3).alias("latency"))


@query("""WITH W AS (SELECT date_trunc('week', ts)::DATE AS week, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2), M AS (SELECT date_trunc('month', week)::DATE AS month, topic, avg(n) AS n FROM W GROUP BY 1, 2) SELECT month, topic, round(n / sum(n) OVER (PARTITION BY month), 6) AS share FROM M""")
def agg_weekly_to_monthly(spark, sf):
    w = read(spark, sf, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    m = w.groupBy(F.to_date(F.date_trunc("month", "week")).alias("month"), "topic").agg(F.avg("n").alias("n"))
    return m.select("month", "topic", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("month")), 6).alias("share"))


@query("""WITH T AS (SELECT lang, sum((doc_id % 2 = 0)::INT)::DOUBLE AS a, sum((doc_id % 2 = 1)::INT)::DOUBLE AS b FROM documents GROUP BY lang) SELECT round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS alignment FROM T""")
def agg_topic_alignment(spark, sf):
    """Cosine of two distributions over topics."""
    t = read(spark, sf, "documents").groupBy("lang").agg(F.sum((F.col("doc_id") % 2 == 0).cast("double")).alias("a"), F.sum((F.col("doc_id") % 2 == 1).cast("double")).alias("b"))
    return t.agg(F.round(F.sum(F.col("a") * F.col("b")) / (F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))), 6).alias("alignment"))


@query("SELECT a.i::INT AS i, b.i::INT AS j, round(covar_samp(a.x, b.x) + CASE WHEN a.i = b.i THEN 1e-5 ELSE 0 END, 6) AS cov FROM (SELECT vec_id, unnest(embedding::DOUBLE[])  AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) a JOIN (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) b ON a.vec_id = b.vec_id AND a.i <= b.i WHERE a.i < 15 AND b.i < 15 GROUP BY a.i, b.i")
def agg_covariances(spark, sf):
    """The covariances of all pairs of 15 features, as detectors use them; the diagonal is raised a little."""
    v = read(spark, sf, "embeddings").select(F.slice("embedding", 1, 15).alias("x"))
    pairs = F.explode(F.expr("flatten(transform(x, (a, i) -> transform(slice(x, i + 1, size(x)), (b, j) -> struct(i AS i, i + j AS j, cast(a AS double) AS a, cast(b AS double) AS b))))"))
    own = v.select(pairs.alias("p")).select("p.*").groupBy("i", "j").agg(F.covar_samp("a", "b").alias("c"))
    return own.select("i", "j", V.rounded(F.col("c") + F.when(F.col("i") == F.col("j"), 1e-5).otherwise(0.0)).alias("cov"))


@query(f"""WITH {B.BASE}, M AS (SELECT q, window_idx, max(sim) AS best FROM S GROUP BY q, window_idx) SELECT window_idx, sum((best >= 0.36::DOUBLE)::INT)::BIGINT AS reused, count(*) AS n, round(avg((best >= 0.36::DOUBLE)::INT), 6) AS rate FROM M GROUP BY window_idx""")
def mem_reuse_rate(spark, sf):
    m = B.served(spark, sf).groupBy("q", "window_idx").agg(F.max("sim").alias("best")).withColumn("r", (F.col("best") >= 0.36).cast("int"))
    return m.groupBy("window_idx").agg(F.sum("r").alias("reused"), F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("rate"))


@query(f"""WITH {B.BASE}, T AS (SELECT q, d, sim, label % 3 <> 0 AS truth FROM S WHERE sim >= 0.2::DOUBLE), N AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rank FROM T WHERE truth) SELECT q, d, rank::INT AS rank FROM N WHERE rank <= 10""")
def fct_retrieve(spark, sf):
    """Facts that hold and are like a question, the best ten: the test of truth comes before the limit."""
    from kbflow.operators import knn

    own = B.served(spark, sf).where("sim >= 0.2D AND label % 3 <> 0")
    return knn.top(own, 10).select("q", "d", "rank")


@query(f"""WITH {B.BASE}, X AS (SELECT G.q, G.d, KR.rank FROM G LEFT JOIN KR ON KR.q = G.q AND KR.d = G.d AND KR.rank <= 10), M AS (SELECT q, avg((rank IS NOT NULL)::INT) AS r, sum((rank IS NOT NULL)::INT) / 10.0::DOUBLE AS p, coalesce(1.0::DOUBLE / min(rank), 0) AS m, max((rank IS NOT NULL)::INT) AS h FROM X GROUP BY q)
SELECT count(*) AS n, round(avg(r), 6) AS recall, round(avg(p), 6) AS precision, round(avg(m), 6) AS mrr, round(avg(h), 6) AS hit_rate FROM M""")
def agg_batch_means(spark, sf):
    from kbflow.operators import knn, metrics

    own = metrics.by_query(B.gold(spark, sf), knn.top(B.served(spark, sf), 10).select("q", "d", "rank"), 10)
    return own.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg((F.col("recall") > 0).cast("int")), 6).alias("hit_rate"))


@query()
def tkb_add(spark, sf):
    """Documents of a topic base in order: to the nearest cluster that is like them, else to a new one while there is room."""
    import pandas as pd

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("d")
        at = fold.topic_add([np.asarray(v, float) for v in own["u"]], 0.4, 50)
        return pd.DataFrame({"label": own["label"].iloc[0], "d": own["d"], "cluster": at})

    return B.kb(spark, sf).select("label", "d", V.unit("dv").alias("u")).groupBy("label").applyInPandas(run, "label int, d long, cluster long")
