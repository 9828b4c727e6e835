"""Question corpora as tables: nested JSON is flattened by explode, pools and queries are made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Files with a JSON object in each line, one after another."""
    return (spark.read.schema(schema) if schema else spark.read).json(list(paths))


def reading(articles: DataFrame) -> DataFrame:
    """(title, context, question, answer) of articles {title, paragraphs [{context, qas [{question, answers [{text}]}]}]}."""
    p = articles.select("title", F.explode("paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("qa"))
    return p.select("title", "context", "qa.question", F.get("qa.answers", F.lit(0))["text"].alias("answer"))


def passages(rows: DataFrame) -> DataFrame:
    """(id, title, text, is_gold) of multi-hop rows {id, context {title [], sentences [[]]}, supporting_facts {title []}}."""
    own = rows.select("id", F.posexplode("context.title").alias("i", "title"), F.col("context.sentences").alias("s"), F.col("supporting_facts.title").alias("gold"))
    return own.select("id", "title", F.array_join(F.get("s", F.col("i")), " ").alias("text"), F.array_contains("gold", F.col("title")).alias("is_gold"))


def pool(found: DataFrame) -> DataFrame:
    """(title, text): the first text of each title, by the id of the row that has it."""
    return found.groupBy("title").agg(F.min_by("text", "id").alias("text"))


def judged(docs: DataFrame, queries: DataFrame, qrels: DataFrame, least: int = 1) -> DataFrame:
    """(query_id, text, gold): queries with the ids of documents that are judged relevant and present."""
    held = qrels.where(F.col("relevance") >= least).join(docs.select("doc_id"), "doc_id", "left_semi")
    return queries.join(held.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("gold")), "query_id").select("query_id", "text", "gold")


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; where there is none, what ``build()`` gives is written first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        build().write.parquet(path)
    return spark.read.parquet(path)
