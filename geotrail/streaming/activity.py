"""Activity periods of partitions, as a stream of accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.params import require_positive


def activity_stream(accesses: DataFrame, window_ms: int, delay: str) -> DataFrame:
    """Periods of ``loc, block`` from ``access_ts``: ``loc, block, from_ts, cold_ts, n_accesses``.

    A period is emitted when the watermark passes the moment it turned cold. Spark joins
    sessions that touch, while a partition is cold already when it has been idle for
    exactly the window: the session gap is one microsecond shorter.
    """
    require_positive(window_ms=window_ms)
    gap = f"{window_ms * 1000 - 1} microseconds"
    return (
        accesses.withWatermark("access_ts", delay)
        .groupBy("loc", "block", F.session_window("access_ts", gap).alias("w"))
        .agg(F.count("*").alias("n_accesses"))
        .select(
            "loc",
            "block",
            F.col("w.start").alias("from_ts"),
            (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("cold_ts"),
            "n_accesses",
        )
    )
