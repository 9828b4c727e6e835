"""What the operators share: work tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and U+0009 to U+000D, and no other.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, an own folder serves a driver that is its own executor, as in tests; on a cluster that would be
    another folder on each machine, so there it is an error.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="kbflow-")
    spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work table; a path that is gone already is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    with suppress(Exception):
        if spark.sparkContext._jsc is not None:
            drop_path(spark, path)


def work_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted at exit."""
    path = f"{work_dir(spark).rstrip('/')}/kbflow/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


class Table:
    """A DataFrame written as Parquet into the shared folder and read again: cuts the lineage and outlives executors."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = work_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """For tables that no later plan reads."""
        drop_path(self.spark, self.path)


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    Returns (node, component) for the nodes that occur in ``edges``; component is the smallest node that can be
    reached. Edges with a null end and loops are ignored. Each step is a grouped minimum with map-side combining
    and an equi-join with a table of minima, so a node with very many neighbours is no single task; each round is a
    written table. No links reach the driver, only a count and a checksum a round.
    """
    u, v = F.col("u"), F.col("v")
    pairs = edges.select(F.col(first).alias("x"), F.col(second).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    now = Table(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    mark = _mark(now.df)
    while True:
        both = now.df.unionByName(now.df.select(v.alias("u"), u.alias("v")))
        least = Table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = Table(both.join(least.df, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct(), "large")
        least_2 = Table(large.df.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.df.join(least_2.df, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        after = Table(small.unionByName(least_2.df.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (now, least, large, least_2):
            old.drop()
        now, before, mark = after, mark, _mark(after.df)
        if mark == before:
            break
    return now.df.select(u.alias("node"), v.alias("component")).unionByName(now.df.select(v.alias("node"), v.alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))).first())


def within(df: DataFrame, rows: int, *sized: str, size: int = 32 << 20) -> bool:
    """Whether ``df`` has at most ``rows`` rows, and its columns ``sized`` at most ``size`` bytes in all: the check before a broadcast."""
    total = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in sized), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n <= rows and held <= size
