"""A window's admissions as a join by rank: the i-th best candidate against the i-th worst resident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swaps(candidates: DataFrame, residents: DataFrame, cap: int, gate: Column | None = None) -> DataFrame:
    """(i, added, removed): candidates (d, value) best first, ties to the larger d, take the places of residents (d, value) worst first, ties to the smaller d.

    ``gate`` is a condition on ``gain`` and ``loss``, the two values; it is monotone in i, as gains fall and losses rise.
    Both lists are cut to ``cap`` rows before they are numbered, so that numbering is of a bounded list.
    """
    best = candidates.orderBy(F.col("value").desc(), F.col("d").desc()).limit(cap).withColumn("i", F.row_number().over(Window.orderBy(F.col("value").desc(), F.col("d").desc())))
    worst = residents.orderBy("value", "d").limit(cap).withColumn("i", F.row_number().over(Window.orderBy("value", "d")))
    both = best.select("i", F.col("d").alias("added"), F.col("value").alias("gain")).join(worst.select("i", F.col("d").alias("removed"), F.col("value").alias("loss")), "i")
    return (both if gate is None else both.where(gate)).select("i", "added", "removed")


def apply(kb: DataFrame, moved: DataFrame) -> DataFrame:
    """The knowledge base (d) after swaps."""
    gone = moved.select(F.col("removed").alias("d"))
    return kb.select("d").join(gone, "d", "left_anti").unionByName(moved.select(F.col("added").alias("d")))


def demand(fetched: DataFrame, gain: float = 0.4, first: float = 1.0) -> DataFrame:
    """(d, demand) from failing queries' fetched documents (q, d, sim, rank): ``first`` for the best, and ``gain`` shared by similarity."""
    share = gain * F.col("sim") / F.sum("sim").over(Window.partitionBy("q"))
    return fetched.withColumn("part", share + F.when(F.col("rank") == 1, first).otherwise(0.0)).groupBy("d").agg(F.sum("part").alias("demand"))
