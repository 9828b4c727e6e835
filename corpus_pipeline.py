"""A corpus pipeline of five stages; each takes and, but for the last, returns the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbflow.llm import line_dedup, packing, secrets, simhash_dedup, toxicity
from kbflow.llm.shared import Table


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars as the text now has them."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from no held-out row."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.reject(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the first stays; documents stay, if need be without text."""
    return _sized(line_dedup.drop_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by five-word shingles stays."""
    return simhash_dedup.one_of_each(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay."""
    return _sized(secrets.redact(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES: list = [("toxicity", toxic), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("secret_scan", secret_spans), ("packing", packed)]
#: The stages score, fingerprint and tokenize with code that SQL has no word for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a written table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
