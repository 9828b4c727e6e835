"""Quality rules with verdicts on hosts: failure rates by host, shrunk with an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbflow.llm.shared import BLANKS, Table, within

#: Base rules: fewest words, and percent of the words that repeated windows may cover at most.
FEWEST, REPEATED = 50, 50
WINDOW = 3
#: A host goes whole if its shrunk rate of failures is over this.
HOST_RATE = 0.8
SYMBOLS = "#*$%&|<>"
#: Rejected hosts that are broadcast at most; more are joined by a shuffle, whose hot keys adaptive execution splits.
BROADCAST_HOSTS = 100_000

_WORDS = r"[^\x20\x09-\x0D]+"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(regexp_extract_all(text, '{_WORDS}')) AS word, generate_subscripts(regexp_extract_all(text, '{_WORDS}'), 1) AS i FROM d),
t AS (SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, word, CASE WHEN w3 IS NOT NULL AND count(*) OVER (PARTITION BY k, word, w2, w3) > 1 THEN 1 ELSE 0 END AS again FROM t),
c AS (SELECT k, i, word, greatest(again, coalesce(lag(again) OVER o, 0), coalesce(lag(again, 2) OVER o, 0)) AS covered FROM r WINDOW o AS (PARTITION BY k ORDER BY i)),
ws AS (SELECT k, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(covered)::BIGINT AS n_repeat_words FROM c GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
ls AS (SELECT k, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM l WHERE regexp_matches(line, '{_WORDS}') GROUP BY k),
b AS (
  SELECT k, doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_words, 0) < {FEWEST} OR 100 * coalesce(n_repeat_words, 0) > {REPEATED} * coalesce(n_words, 0) AS base_failed
  FROM d LEFT JOIN ws USING (k) LEFT JOIN ls USING (k)),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(f / n) AS mean, coalesce(var_pop(f / n), 0) AS spread, avg(1 / n) AS noise FROM h),
s AS (SELECT mean, least(1e6, greatest(1, mean * (1 - mean) / greatest(1e-9, spread - mean * (1 - mean) * noise) - 1)) AS strength FROM m),
v AS (SELECT source, (f + mean * strength) / (n + strength) > {HOST_RATE} AS gone FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(gone, false) AS kept
FROM b LEFT JOIN v USING (source)
"""


def words(text: Column) -> Column:
    """Words between blanks and U+0009 to U+000D."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), one pass without a shuffle.

    n_repeat_words counts the words that lie in a three-word window which the text has twice or more. Only texts with
    such a window sort their windows to find the places.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    own = own.withColumn("words", words(F.col("text"))).withColumn("lines", lines)
    own = own.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(F.slice("words", 1, F.size("words") - WINDOW + 1), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)))).alias("windows"),
    )
    placed = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("i"))))
    own = own.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    twice = F.filter("placed", lambda x, k: (x["w"] == F.get("placed", k - 1)["w"]) | (x["w"] == F.get("placed", k + 1)["w"]))
    own = own.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("placed")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("at", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n")), lambda a: a["n"])
    own = own.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")
    return own.withColumn("base_failed", (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n, failed, rate) with rate shrunk towards the prior that the hosts' own rates suggest.

    The prior's mean is the mean of the hosts' rates, its strength follows by moments from their variance less what
    chance gives; it is held between 1 and a million documents. Rows without a host belong to none.
    """
    hosts = measured.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("base_failed").cast("double")).alias("failed"))
    hosts = Table(hosts, "hosts").df
    raw = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(raw).alias("mean"), F.coalesce(F.var_pop(raw), F.lit(0.0)).alias("spread"), F.avg(1 / F.col("n")).alias("noise")).first()
    mean, spread, noise = (prior[c] if prior[c] is not None else 0.0 for c in ("mean", "spread", "noise"))
    strength = min(1e6, max(1.0, mean * (1 - mean) / max(1e-9, spread - mean * (1 - mean) * noise) - 1))
    return hosts.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("n") + strength))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host) of each row.

    kept: the document passes the base rules, and its host's shrunk rate of failures is not over ``host_rate``. Null
    texts have no words and fail; a null host has no verdict of its own. Null and repeated ids give a row each; other
    columns are not read; an empty table gives none.
    """
    measured = Table(measures(docs, id_col, text_col, host_col), "measures").df
    gone = host_rates(measured).where(F.col("rate") > host_rate).select("host", F.lit(True).alias("gone"))
    gone = F.broadcast(gone) if within(gone, broadcast_hosts, "host") else gone
    kept = ~F.col("base_failed") & F.col("gone").isNull()
    return measured.join(gone, "host", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host")
