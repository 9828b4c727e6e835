"""URL rules: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, and confirmation of full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbflow.llm.shared import within

#: The rules of the registered query: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DEFAULT = "allow"
#: Hex digits of a digest that the join compares; the rest is confirmed after it.
PREFIX = 8
#: Rules that are broadcast at most; longer lists are joined by a shuffle, whose hot keys adaptive execution splits.
BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
best AS (
  SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM parts LEFT JOIN best USING (n)
"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = ", ".join("('{}', '{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages``.

    A rule (host, path, verdict) fits its host and all subdomains if the path starts with the rule's. The longest
    host and path together win; of equal ones the longer host, and then ``block``. Without a rule: null and
    ``default``. A null url, or one without ``://``, has an empty host and path. Rules with nulls fit nothing; of
    rules that name the same host and path ``block`` wins. Null and repeated ids give a row each; other columns are
    not read; an empty table gives none.

    A URL is expanded only to the numbers of host labels and lengths of path that some rule has: no other expression
    could meet a rule. Expressions are made and reduced to a row for each page before the one shuffle, which moves
    ids and URLs only.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("r_verdict"))  # of allow and block the latter
    shapes = sorted(tuple(r) for r in rules.select((F.length("host") - F.length(F.replace("host", F.lit("."))) + 1).alias("labels"), F.length("path").alias("size")).distinct().collect())
    text = F.concat(F.col("host"), F.lit(" "), F.col("path"))  # a host may hold blanks, a rule's path begins where its length says
    known = rules.select(F.sha2(text, 256).alias("digest"), F.concat("host", "path").alias("r_rule"), F.length("host").alias("r_host"), "r_verdict")
    known = known.withColumn("prefix", F.substring("digest", 1, PREFIX)).withColumnRenamed("digest", "r_digest")
    host, path = host_and_path(F.col("url"))
    # Rows of a page stay in its task until they are summed, so the task's number in the key keeps repeated rows apart.
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("task", F.spark_partition_id())
    source = source.withColumn("host", host).withColumn("path", path)
    dots = F.length("host") - F.length(F.replace("host", F.lit(".")))
    made = [F.when((dots >= labels - 1) & (F.length("path") >= size), F.sha2(F.concat(F.substring_index("host", ".", -labels), F.lit(" "), F.substring("path", 1, size)), 256)) for labels, size in shapes]
    own = source.select("page_id", "url", "task", F.explode(F.array(F.lit(""), *made)).alias("digest")).where("digest IS NOT NULL")
    own = own.withColumn("prefix", F.substring("digest", 1, PREFIX))
    known = F.broadcast(known) if within(known, broadcast_rules, "r_rule", "r_digest") else known
    met = own.join(known, "prefix", "left").withColumn("fits", F.col("digest") == F.col("r_digest"))
    best = F.max(F.when(F.col("fits"), F.struct(F.length("r_rule").alias("n"), "r_host", "r_verdict", "r_rule"))).alias("best")
    held = met.groupBy("task", "page_id", "url").agg(best, F.sum(F.when(F.col("digest") == "", 1).otherwise(0)).cast("int").alias("times"))
    host, path = host_and_path(F.col("url"))
    found = held.select("page_id", host.alias("host"), path.alias("path"), F.col("best.r_rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"), "times")
    return found.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))
