"""Structured Streaming: a knowledge base that follows a stream of queries, window by window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[DataFrame, DataFrame, int], DataFrame]


def count_windows(events: DataFrame, size: int, key: str = "user_id") -> DataFrame:
    """(key, window_idx, n, total) for each ``size`` values of a key's stream; what is left waits in the state for more.

    ``events`` is a stream with the key and ``value``; the state of a key is a count and a sum, whatever its stream's length.
    """

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for batch in batches:
            for value in batch["value"]:
                n, total = n + 1, total + float(value)
                if n == size:
                    out.append((own[0], window, n, total))
                    window, n, total = window + 1, 0, 0.0
        state.update((window, n, total))
        yield pd.DataFrame(out, columns=[key, "window_idx", "n", "total"])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, window_idx long, n long, total double", "window long, n long, total double", "append", GroupStateTimeout.NoTimeout)


def follow(queries: DataFrame, folder: str, step: Step, checkpoint: str) -> StreamingQuery:
    """Run a policy over micro-batches: ``step(batch, kb, version)`` gives the next version of the knowledge base (d).

    Versions are written tables kb-0, kb-1, ... below ``folder``; kb-0 must be there. A batch that runs again writes its
    version once more, from the same one before it, so a restart loses and doubles nothing.
    """

    def one(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        step(batch, spark.read.parquet(f"{folder}/kb-{version}"), version).write.mode("overwrite").parquet(f"{folder}/kb-{version + 1}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shares(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of each topic by tumbling windows of event time, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").count()
