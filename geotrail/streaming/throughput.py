"""Queries finished in each tick, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput_stream(finished: DataFrame, tick: str, delay: str) -> DataFrame:
    """Tumbling counts of ``finished_ts``: ``tick_start, tick_end, finished``.

    A tick is emitted once the watermark, ``delay`` behind the newest row, passes its
    end; rows later than that are dropped. State is one number for each open tick.
    """
    return (
        finished.withWatermark("finished_ts", delay)
        .groupBy(F.window("finished_ts", tick).alias("w"))
        .agg(F.count("*").alias("finished"))
        .select(F.col("w.start").alias("tick_start"), F.col("w.end").alias("tick_end"), "finished")
    )
