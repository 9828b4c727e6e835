"""Metrics over ranked results, versions of a knowledge base, and series of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(q, recall): the share of a query's gold documents (q, d) among those found; queries without gold are left out."""
    hit = found.select("q", "d").distinct().withColumn("hit", F.lit(1.0))
    return gold.distinct().join(hit, ["q", "d"], "left").groupBy("q").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def windowed(by_query: DataFrame, windows: DataFrame) -> DataFrame:
    own = by_query.join(windows, "q").groupBy("window_idx")
    return own.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 6).alias("recall"))


def by_query(gold: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(q, recall, precision, mrr) of results (q, d, rank) with at most k rows a query."""
    both = gold.join(found.select("q", "d", "rank"), ["q", "d"], "left").groupBy("q")
    hits = F.count("rank")
    return both.agg(F.round(hits / F.count(F.lit(1)), 6).alias("recall"), F.round(hits / F.lit(float(k)), 6).alias("precision"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"))


def coverage(gold: DataFrame, kb: DataFrame) -> DataFrame:
    """(window_idx, coverage, cumulative) of gold documents (window_idx, d) by a knowledge base (d); cumulative counts each document at its first window."""
    marked = gold.join(kb.select("d", F.lit(1).alias("held")), "d", "left").select("window_idx", "d", F.coalesce("held", F.lit(0)).alias("held"))
    marked = marked.withColumn("new", (F.row_number().over(Window.partitionBy("d").orderBy("window_idx")) == 1).cast("int"))
    own = marked.groupBy("window_idx").agg(F.avg("held").alias("c"), F.sum("new").alias("new"), F.sum(F.col("new") * F.col("held")).alias("new_held"))
    before = Window.orderBy("window_idx").rowsBetween(Window.unboundedPreceding, 0)  # a row a window
    return own.select("window_idx", F.round("c", 6).alias("coverage"), F.round(F.sum("new_held").over(before) / F.sum("new").over(before), 6).alias("cumulative"))


def turnover(versions: DataFrame) -> DataFrame:
    """(version, turnover): symmetric difference over union with the version before; versions: distinct (version, d).

    One pass: a document's row tells by the version before it in its own list whether it was there.
    """
    stayed = F.lag("version").over(Window.partitionBy("d").orderBy("version")) == F.col("version") - 1
    own = versions.withColumn("stayed", F.coalesce(stayed, F.lit(False)).cast("int")).groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.sum("stayed").alias("both"))
    order = Window.orderBy("version")  # a row a version
    own = own.withColumn("was", F.lag("n").over(order)).withColumn("prior", F.lag("version").over(order)).where("prior = version - 1")
    return own.select("version", F.round(1 - F.col("both") / (F.col("n") + F.col("was") - F.col("both")), 6).alias("turnover"))


def drift(counts: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(day, jsd): Jensen-Shannon divergence (natural logarithm) of each day's shares of topics from the day's before; counts: (day, topic, n)."""
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("day")))
    full = share.select("day").distinct().crossJoin(share.select("topic").distinct())
    own = full.join(share, ["day", "topic"], "left").select("day", "topic", (F.coalesce("p", F.lit(0.0)) + eps).alias("p"))
    own = own.withColumn("q", F.lag("p").over(Window.partitionBy("topic").orderBy("day"))).where("q IS NOT NULL")
    mid = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.sum(F.col(c) * F.log(F.col(c) / mid))
    return own.groupBy("day").agg(F.round(0.5 * part("p") + 0.5 * part("q"), 6).alias("jsd"))


def running(series: DataFrame, beta: float) -> DataFrame:
    """(i, ema, mad) of a bounded series (i, v), a value a window: a fold over its values in order."""
    one = series.agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("own"))
    zero = F.expr("CAST(array() AS array<struct<i:bigint,ema:double,mad:double>>)")

    def step(acc, x):
        ema = F.when(F.size(acc) == 0, x["v"]).otherwise(beta * F.try_element_at(acc, F.lit(-1))["ema"] + (1 - beta) * x["v"])
        mad = F.when(F.size(acc) == 0, 0.0).otherwise(beta * F.try_element_at(acc, F.lit(-1))["mad"] + (1 - beta) * F.abs(x["v"] - ema))
        return F.concat(acc, F.array(F.struct(x["i"].alias("i"), ema.alias("ema"), mad.alias("mad"))))

    out = one.select(F.explode(F.aggregate("own", zero, step)).alias("r"))
    return out.select("r.i", F.round("r.ema", 5).alias("ema"), F.round("r.mad", 5).alias("mad"))


def adaptation(blocks: DataFrame, share: float = 0.9) -> DataFrame:
    """One row of a series of windows (w, m): precision, adaptation, first_half, second_half."""
    up = F.col("m") - F.lag("m").over(Window.orderBy("w"))
    ends = blocks.agg(F.max("m").alias("peak"), F.min(F.struct("m", "w"))["w"].alias("at"), F.expr("(max(w) + 1) div 2").alias("half"))
    own = blocks.withColumn("up", up).crossJoin(F.broadcast(ends))
    back = F.min(F.when((F.col("w") >= F.col("at")) & (F.col("m") >= share * F.col("peak")), F.col("w") - F.col("at")))
    return own.agg(
        F.round(F.sum(F.greatest("up", F.lit(0.0))) / F.count(F.lit(1)), 6).alias("precision"), back.alias("adaptation"),
        F.round(F.avg(F.when(F.col("w") < F.col("half"), F.col("m"))), 6).alias("first_half"), F.round(F.avg(F.when(F.col("w") >= F.col("half"), F.col("m"))), 6).alias("second_half"),
    )
