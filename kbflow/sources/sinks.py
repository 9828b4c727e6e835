"""Reports: results as JSON, tables of averages as Markdown, and what a written index is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(results: DataFrame, group: str, key: str) -> DataFrame:
    """(group, json): for each group an object of its rows by ``key``, values as they are; keys ascend."""
    rest = [c for c in results.columns if c not in (group, key)]
    own = results.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(key, F.struct(*rest).alias("v")))).alias("own"))
    return own.select(group, F.to_json(F.map_from_entries(F.transform("own", lambda x: F.struct(x[key].cast("string"), x["v"])))).alias("json"))


def markdown(table: DataFrame, rows: int = 1000) -> str:
    """A table of a report, in its order; a report has at most ``rows`` rows."""
    shown = table.limit(rows).collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(table.columns), line(["---"] * len(table.columns)), *(line(["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r]) for r in shown)])


def save(index: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Write an index, and beside it one row: rows, distinct ids, characters, and a hash of the contents that ignores their order."""
    index.write.mode("overwrite").parquet(f"{path}/index")
    spark = index.sparkSession
    held = spark.read.parquet(f"{path}/index")
    meta = held.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("ids"), F.sum(F.length(text_col)).alias("characters"), F.sum(F.xxhash64(id_col, text_col).cast("decimal(38,0)")).cast("string").alias("content"))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return spark.read.json(f"{path}/metadata")


def consistent(index: DataFrame, docs: DataFrame, id_col: str) -> bool:
    """Whether an index has as many ids as there are documents."""
    return index.select(id_col).distinct().count() == docs.select(id_col).distinct().count()
