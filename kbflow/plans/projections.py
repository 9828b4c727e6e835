"""Projections, scalar functions and filters over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbflow.functions import text as T
from kbflow.functions import vectors as V
from kbflow.plans.register import query, read


@query("SELECT doc_id, 'passage: ' || source || ': ' || substr(text, 1, 256) AS passage, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS short FROM documents")
def prj_embedding_text(spark, sf):
    d = read(spark, sf, "documents")
    short = F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 300), F.lit("..."))).otherwise(F.col("text"))
    return d.select("doc_id", T.embedding_text(F.col("source"), F.col("text"), "passage: ").alias("passage"), short.alias("short"))


@query("""SELECT doc_id, 'doc_' || substr(md5(text), 1, 12) AS text_id, 'hp_' || substr(md5(source || substr(text, 1, 100)), 1, 10) AS title_id, md5(text) AS fingerprint FROM documents""")
def prj_content_ids(spark, sf):
    d = read(spark, sf, "documents")
    title = T.content_id("hp_", F.concat("source", F.substring("text", 1, 100)), 10)
    return d.select("doc_id", T.content_id("doc_", F.col("text"), 12).alias("text_id"), title.alias("title_id"), F.md5("text").alias("fingerprint"))


@query("""SELECT source AS title, 'doc' || lpad((row_number() OVER (ORDER BY source) - 1)::VARCHAR, 6, '0') AS pool_id FROM (SELECT DISTINCT source FROM documents)""")
def prj_dense_ids(spark, sf):
    from pyspark.sql import Window

    d = read(spark, sf, "documents").select(F.col("source").alias("title")).distinct()
    return d.select("title", F.concat(F.lit("doc"), F.lpad((F.row_number().over(Window.orderBy("title")) - 1).cast("string"), 6, "0")).alias("pool_id"))


@query(r"""SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM benchmark""")
def prj_answer_norm(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", T.normal_answer(F.col("text")).alias("answer"))


@query(r"""WITH e AS (SELECT p_partkey, replace(replace(replace(p_name, '_', ' '), '-LRB-', '('), '-RRB-', ')') AS t, regexp_replace(lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))), '^the ', '') AS e FROM part)
SELECT p_partkey, lower(trim(t)) AS title, CASE WHEN length(e) > 1 AND length(e) < 80 THEN e END AS entity FROM e""")
def prj_title_entity_norm(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", T.normal_title(F.col("p_name")).alias("title"), T.normal_entity(F.col("p_name")).alias("entity"))


@query("""SELECT p_partkey, CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, 1, strpos(p_name, ' ') - 1) ELSE '' END AS title, CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE p_name END AS passage, coalesce(nullif(p_type, ''), 'unknown') AS topic FROM part""")
def prj_split_passage(spark, sf):
    own = F.split("p_name", " ", 2)
    two = F.size(own) > 1
    return read(spark, sf, "part").select("p_partkey", F.when(two, own[0]).otherwise("").alias("title"), F.when(two, F.get(own, 1)).otherwise(F.col("p_name")).alias("passage"), F.coalesce(F.nullif("p_type", F.lit("")), F.lit("unknown")).alias("topic"))


@query(r"""WITH y AS (SELECT o_orderkey, regexp_extract('order of ' || strftime(o_orderdate, '%Y-%m-%d'), '\b(19[0-9]{2}|20[0-9]{2})\b', 1)::INT AS year FROM orders)
SELECT o_orderkey, year, CASE WHEN year <= 1993 THEN 1 WHEN year <= 1995 THEN 2 WHEN year <= 1997 THEN 3 WHEN year <= 2020 THEN 4 ELSE 5 END AS round FROM y WHERE year BETWEEN 1900 AND 2030""")
def prj_year_rounds(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("order of "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"))
    year = F.regexp_extract("t", r"\b(19[0-9]{2}|20[0-9]{2})\b", 1).cast("int")
    o = o.select("o_orderkey", year.alias("year")).where("year BETWEEN 1900 AND 2030")
    bins = F.when(F.col("year") <= 1993, 1).when(F.col("year") <= 1995, 2).when(F.col("year") <= 1997, 3).when(F.col("year") <= 2020, 4).otherwise(5)
    return o.withColumn("round", bins)


_RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in T.TOPIC_RULES) + " ELSE 'other' END"
_TOPICS = {"articles": ("the", "der", "le", "el"), "joins": ("and", "und", "et", "y")}


@query(f"""SELECT conv_id, turn, {_RULES_SQL} AS topic,
CASE {" ".join(f"WHEN list_has_any(string_split_regex(lower(text), '[ \t\n]+'), {list(w)}) THEN '{n}'" for n, w in _TOPICS.items())} ELSE 'other' END AS keyword_topic FROM conversations""")
def prj_topics(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.first_rule(F.col("text")).alias("topic"), T.keyword_topic(F.col("text"), _TOPICS).alias("keyword_topic"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''))::INT AS n_tokens, length(trim(text)) >= 2 AS asked FROM documents WHERE length(trim(text)) >= 2""")
def prj_tokens(spark, sf):
    d = read(spark, sf, "documents").where(F.length(F.trim("text")) >= 2)
    return d.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), (F.length(F.trim("text")) >= 2).alias("asked"))


@query("""WITH n AS (SELECT doc_id, text, greatest(1, ceil((length(text) - 128) / 896.0))::INT AS n FROM documents)
SELECT doc_id, i::INT AS chunk_id, substr(text, (i * 896 + 1)::INT, 1024) AS chunk FROM n, range(n) AS r(i)""")
def prj_chunks(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_id", "chunk"))


@query(r"""WITH r AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source, string_agg('[' || n || '] ' || substr(regexp_replace(text, '[\n\t]', ' ', 'g'), 1, 300), chr(10) || chr(10) ORDER BY n) AS context FROM r WHERE n <= 3 GROUP BY source""")
def prj_context(spark, sf):
    from pyspark.sql import Window

    d = read(spark, sf, "documents").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 3")
    own = d.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("own"))
    return own.select("source", T.context(F.transform("own", lambda x: x["text"])).alias("context"))


@query(r"""WITH t AS (SELECT conv_id, turn, '<think>plan</think> ' || text AS answer, text || ' grade ' || (turn % 7) AS graded FROM conversations)
SELECT conv_id, turn, trim(string_split(answer, '</think>')[-1]) AS answer, coalesce(nullif(regexp_extract(graded, '[1-5]'), ''), '3')::INT AS grade,
CASE WHEN contains(lower(graded), 'reinforce') THEN 'reinforce' WHEN contains(lower(graded), 'make false') OR contains(lower(graded), 'make_false') THEN 'make_false' ELSE 'no_change' END AS verdict,
CASE WHEN regexp_matches(lower(graded), 'time ?out') THEN 'timeout' WHEN regexp_matches(lower(graded), 'rate|quota|429') THEN 'rate_limit' WHEN regexp_matches(lower(graded), 'connect|network') THEN 'network' ELSE 'unknown' END AS error FROM t""")
def prj_model_output(spark, sf):
    c = read(spark, sf, "conversations")
    answer, graded = F.concat(F.lit("<think>plan</think> "), "text"), F.concat(F.col("text"), F.lit(" grade "), (F.col("turn") % 7).cast("string"))
    return c.select("conv_id", "turn", T.after_thinking(answer).alias("answer"), T.first_grade(graded).alias("grade"), T.verdict(graded).alias("verdict"), T.error_kind(graded).alias("error"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v)
SELECT vec_id, round(n, 6) AS norm, round(v[1] / greatest(n, 1e-10), 6) AS first, round(list_inner_product(v, v) / greatest(n, 1e-10) / greatest(n, 1e-10), 6) AS self_sim FROM n""")
def vec_unit(spark, sf):
    e = read(spark, sf, "embeddings").withColumn("u", V.unit("embedding"))
    return e.select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"), V.rounded(F.get("u", F.lit(0))).alias("first"), F.round(V.dot("u", "u"), 6).alias("self_sim"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i)
SELECT label, i::INT - 1 AS dim, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-10), 6) AS x FROM m""")
def vec_centroids(spark, sf):
    from pyspark.sql import Window

    m = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return m.select("label", "dim", V.rounded(F.col("m") / F.greatest(length, F.lit(1e-10))).alias("x"))


@query("""SELECT vec_id, round(exp(-abs(2014 - (2008 + vec_id % 13)) / 2.0::DOUBLE), 6) AS freshness, round(pow(0.88::DOUBLE, vec_id % 50) * (1 + vec_id % 7), 6) AS decayed, abs(2014 - (2008 + vec_id % 13)) <= 2 AS in_era FROM embeddings""")
def mth_decay(spark, sf):
    gap = F.abs(2014 - (2008 + F.col("vec_id") % 13))
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.exp(-gap / 2.0), 6).alias("freshness"), F.round(F.pow(F.lit(0.88), F.col("vec_id") % 50) * (1 + F.col("vec_id") % 7), 6).alias("decayed"), (gap <= 2).alias("in_era"))


@query("""WITH s AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events)
SELECT user_id, round(CASE WHEN count(gap) = 0 THEN 0.95 ELSE least(1.2, greatest(0.7, exp(-5.0::DOUBLE * min(gap)))) END, 6) AS temperature FROM s GROUP BY user_id""")
def mth_temperature(spark, sf):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("value", "event_id")
    e = read(spark, sf, "events").withColumn("gap", F.col("value") - F.lag("value").over(own))
    t = F.when(F.count("gap") == 0, 0.95).otherwise(F.least(F.lit(1.2), F.greatest(F.lit(0.7), F.exp(-5.0 * F.min("gap")))))
    return e.groupBy("user_id").agg(F.round(t, 6).alias("temperature"))


@query("""WITH u AS (SELECT user_id, avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END) AS recall, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS updates FROM events GROUP BY user_id)
SELECT user_id, round(recall / (1 + log2(updates + 1)), 6) AS efficiency, round(recall - 0.01::DOUBLE * updates, 6) AS adjusted, round(0.5::DOUBLE * recall + 0.3::DOUBLE / (1 + updates) + 0.2::DOUBLE * recall * recall, 6) AS composite FROM u""")
def mth_efficiency(spark, sf):
    u = read(spark, sf, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("u"))
    r, n = F.col("r"), F.col("u")
    return u.select("user_id", F.round(r / (1 + F.log2(n + 1)), 6).alias("efficiency"), F.round(r - 0.01 * n, 6).alias("adjusted"), F.round(0.5 * r + 0.3 / (1 + n) + 0.2 * r * r, 6).alias("composite"))


@query("""WITH s AS (SELECT i AS seq, i / 99.0::DOUBLE AS t FROM range(100) r(i)), k AS (SELECT j AS topic, (j + 0.5::DOUBLE) / 5 AS mid FROM range(5) r(j)),
w AS (SELECT seq, topic, exp(-(t - mid) * (t - mid) / (2 * 0.18::DOUBLE * 0.18::DOUBLE)) AS g, 1 / (1 + exp(-30.0::DOUBLE * (t - topic / 5.0::DOUBLE))) * (1 - 1 / (1 + exp(-30.0::DOUBLE * (t - (topic + 1) / 5.0::DOUBLE)))) AS s,
  exp(-pow((t * 2 - floor(t * 2)) - mid, 2) / (2 * 0.08::DOUBLE * 0.08::DOUBLE)) + 1e-9::DOUBLE AS c FROM s, k)
SELECT seq::INT AS seq, topic::INT AS topic, round(g / sum(g) OVER o, 6) AS gradual, round(s / sum(s) OVER o, 6) AS sudden, round(c / sum(c) OVER o, 6) AS cyclic FROM w WINDOW o AS (PARTITION BY seq)""")
def mth_schedules(spark, sf):
    from kbflow.operators.stream import schedules

    return schedules(spark, 100, 5)


@query("""SELECT doc_id, n_chars, lang FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 200 AND NOT starts_with(text, 'The') AND text <> ''""")
def flt_types(spark, sf):
    return read(spark, sf, "documents").where(F.col("lang").isin("en", "de") & (F.col("n_chars") >= 200) & ~F.startswith("text", F.lit("The")) & (F.col("text") != "")).select("doc_id", "n_chars", "lang")


@query(r"""WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''))) AS w FROM benchmark),
v AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents) SELECT item_id, w FROM q WHERE w IN (SELECT w FROM v)""")
def flt_known_words(spark, sf):
    q = read(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    return q.join(read(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct(), "w", "left_semi").select("item_id", "w")


@query("""WITH g AS (SELECT o_orderkey, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 20 GROUP BY o_orderkey) SELECT o_orderkey, n FROM g WHERE n >= 2""")
def flt_two_gold(spark, sf):
    pool = read(spark, sf, "part").where("p_size <= 20").select(F.col("p_partkey").alias("l_partkey"))
    gold = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct().join(pool, "l_partkey", "left_semi")
    own = gold.join(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return own.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""WITH h AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS h FROM events GROUP BY user_id) SELECT user_id, len(h)::INT AS n, h[-1] AS last FROM h WHERE h[-1] <> 'error'""")
def flt_true_facts(spark, sf):
    """Facts whose last entry holds; a fact is a user here, its history their events."""
    h = read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return h.where("last <> 'error'").select("user_id", "n", "last")
