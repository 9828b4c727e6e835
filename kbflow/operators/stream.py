"""Query streams with controlled drift: schedules, reproducible samples, windows by count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def order_key(seed: object, *keys: Column | str) -> Column:
    """What samples are ordered by: the same in every engine and on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def sample(df: DataFrame, n: int, seed: object, key: str) -> DataFrame:
    """n rows, those of the smallest keys: a top-n, no full sort."""
    return df.orderBy(order_key(seed, key), key).limit(n)


def window_of(seq: Column | str, size: int) -> Column:
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / size).cast("long")


def schedules(spark: SparkSession, steps: int, topics: int, sigma: float = 0.18, steep: float = 30.0, narrow: float = 0.08, cycles: int = 2) -> DataFrame:
    """(seq, topic, gradual, sudden, cyclic): shares of topics over time, each step's shares sum to 1."""
    t, k = F.col("seq") / F.lit(float(steps - 1)), F.col("topic")
    middle = (k + 0.5) / topics
    rise = lambda at: 1 / (1 + F.exp(-steep * (t - at)))
    phase = t * cycles - F.floor(t * cycles)
    bell = lambda x, s: F.exp(-(x - middle) * (x - middle) / (2 * s * s))
    grid = spark.range(steps).select(F.col("id").cast("int").alias("seq"), F.explode(F.sequence(F.lit(0), F.lit(topics - 1))).alias("topic"))
    raw = grid.select("seq", "topic", bell(t, sigma).alias("g"), (rise(k / float(topics)) * (1 - rise((k + 1) / float(topics)))).alias("s"), (bell(phase, narrow) + 1e-9).alias("c"))
    own = Window.partitionBy("seq")
    return raw.select("seq", "topic", *(F.round(F.col(a) / F.sum(a).over(own), 6).alias(b) for a, b in (("g", "gradual"), ("s", "sudden"), ("c", "cyclic"))))


def drift(queries: DataFrame, windows: int, size: int, head: Column, early: float = 0.97, late: float = 0.03, seed: object = 42, share: Column | None = None) -> DataFrame:
    """(window_idx, pos, q, is_head): windows of ``size`` queries, of which a share are head queries.

    ``share`` is an expression over window_idx; without it the share flips from early to late at half time. Head and
    tail queries are drawn in the order of their keys, again from the start when they run out. Queries are numbered
    within buckets of their keys, and buckets by their counts, so no task numbers them all.
    """
    spark = queries.sparkSession
    share = F.when(F.col("window_idx") < windows // 2, early).otherwise(late) if share is None else share
    slots = spark.range(windows).select(F.col("id").alias("window_idx")).withColumn("heads", F.bround(share * size).cast("int"))
    before = Window.orderBy("window_idx").rowsBetween(Window.unboundedPreceding, -1)  # a row a window
    slots = slots.withColumn("head_base", F.coalesce(F.sum("heads").over(before), F.lit(0))).withColumn("tail_base", F.col("window_idx") * size - F.col("head_base"))
    slots = slots.select("window_idx", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos"), "heads", "head_base", "tail_base").withColumn("is_head", F.col("pos") < F.col("heads"))
    turn = F.when(F.col("is_head"), F.col("head_base") + F.col("pos")).otherwise(F.col("tail_base") + F.col("pos") - F.col("heads"))
    keyed = queries.select("q", head.alias("is_head"), order_key(seed, "q").alias("key")).withColumn("bucket", F.substring("key", 1, 3))
    counts = keyed.groupBy("is_head", "bucket").agg(F.count(F.lit(1)).alias("k"))  # 8,192 rows at most
    sooner = Window.partitionBy("is_head").orderBy("bucket")
    counts = counts.withColumn("base", F.sum("k").over(sooner) - F.col("k")).withColumn("size", F.sum("k").over(Window.partitionBy("is_head")))
    drawn = keyed.join(F.broadcast(counts), ["is_head", "bucket"])
    drawn = drawn.withColumn("n", F.col("base") + F.row_number().over(Window.partitionBy("is_head", "bucket").orderBy("key", "q")) - 1)
    sizes = counts.select("is_head", "size").distinct()
    asked = slots.withColumn("turn", turn).join(F.broadcast(sizes), "is_head").withColumn("n", F.col("turn") % F.col("size"))
    return asked.join(drawn.select("is_head", "n", "q"), ["is_head", "n"]).select("window_idx", "pos", "q", "is_head")
