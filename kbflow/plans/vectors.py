"""The bindings of the vector tables: queries, pool and knowledge base, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbflow.operators import knn
from kbflow.operators.stream import sample
from kbflow.plans.register import read

BUDGET, WINDOW, HIT, K = 100, 10, 0.30, 5

BASE = f"""Q AS (SELECT vec_id AS q, vec_id // 10 AS seq, vec_id // {10 * WINDOW} AS window_idx, label AS q_label, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 10 = 0),
P AS (SELECT vec_id AS d, label, embedding::DOUBLE[] AS dv FROM embeddings WHERE vec_id % 10 <> 0),
KB AS (SELECT d, label, dv FROM P ORDER BY md5('42|' || d), d LIMIT {BUDGET}),
S AS (SELECT q, seq, window_idx, q_label, d, label, list_inner_product(qv, dv) AS sim FROM Q, KB),
A AS (SELECT q, seq, window_idx, d, label, list_inner_product(qv, dv) AS sim FROM Q, P),
R AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rank FROM A),
G AS (SELECT q, d FROM R WHERE rank <= 2),
KR AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rank FROM S),
F1 AS (SELECT q, max(sim) AS best FROM S GROUP BY q)"""


def queries(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings").where("vec_id % 10 = 0")
    return e.select(F.col("vec_id").alias("q"), F.expr("vec_id div 10").alias("seq"), F.expr(f"vec_id div {10 * WINDOW}").alias("window_idx"), F.col("label").alias("q_label"), F.col("embedding").alias("qv"))


def pool(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").where("vec_id % 10 <> 0").select(F.col("vec_id").alias("d"), "label", F.col("embedding").alias("dv"))


def kb(spark, sf) -> DataFrame:
    """The initial knowledge base: the BUDGET pool documents of the smallest keys."""
    return sample(pool(spark, sf), BUDGET, 42, "d")


def served(spark, sf) -> DataFrame:
    """Similarities of all queries with all documents of the knowledge base."""
    return knn.pairs(queries(spark, sf), kb(spark, sf), BUDGET)


def fetched(spark, sf, k: int) -> DataFrame:
    return knn.nearest(queries(spark, sf), pool(spark, sf), k)


def gold(spark, sf, window: int | None = None) -> DataFrame:
    """Each query's two nearest pool documents; those of one window's queries are searched alone."""
    asked = queries(spark, sf)
    return knn.nearest(asked if window is None else asked.where(F.col("window_idx") == window), pool(spark, sf), 2).select("q", "d")
