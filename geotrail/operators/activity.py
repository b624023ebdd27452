"""Hot and cold partitions, as tables derived from an access log.

An access log has ``loc, block, access_ms``. A status table has one row for each
partition: ``loc, block, active_ms, is_hot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail.operators.gather import MAX_POINTS, gather_partitions
from geotrail.params import require_positive

KEYS = ["loc", "block"]


def _keys_of(df: DataFrame) -> DataFrame:
    return df.select(*KEYS).distinct()


def access_log(candidates: DataFrame) -> DataFrame:
    """Accesses made by a workload: its candidate partitions at the time of issue."""
    return candidates.select("query_id", *KEYS, F.col("issued_ms").alias("access_ms"))


def last_access(log: DataFrame, until_ms: int | None = None) -> DataFrame:
    """Time of the last access to each partition, up to ``until_ms`` if given."""
    if until_ms is not None:
        log = log.where(F.col("access_ms") <= until_ms)
    return log.groupBy(*KEYS).agg(F.max("access_ms").alias("last_ms"))


def classify_partitions(
    keys: DataFrame, accesses: DataFrame, now_ms: int, window_ms: int, delay_ms: int = 0, loaded_ms: int = 0
) -> DataFrame:
    """Status at ``now_ms``: cold once ``now >= last access + window + delay``.

    A partition without an access counts from the time it was loaded.
    """
    require_positive(window_ms=window_ms)
    active = F.coalesce("last_ms", F.lit(loaded_ms)).cast("bigint")
    return (
        keys.select(*KEYS)
        .join(accesses, KEYS, "left")
        .select(*KEYS, active.alias("active_ms"))
        .withColumn("is_hot", F.lit(now_ms) < F.col("active_ms") + window_ms + delay_ms)
    )


def evict_cold(keyed: DataFrame, status: DataFrame, max_points: int = MAX_POINTS, longest: int | None = None) -> DataFrame:
    """Nested partitions with the contents of cold ones hidden: key kept, empty bag."""
    hot = keyed.join(_keys_of(status.where("is_hot")), KEYS, "left_semi")
    kept = gather_partitions(hot, max_points, longest).withColumn("is_hot", F.lit(True))
    empty = F.array().cast(kept.schema["points"].dataType)
    emptied = status.where("NOT is_hot").select(
        *KEYS, F.lit(0).cast("bigint").alias("part"), empty.alias("points"), F.lit(False).alias("is_hot")
    )
    return kept.unionByName(emptied)


def all_cold(keys: DataFrame) -> DataFrame:
    """Every key, cold, with null contents."""
    nothing = F.lit(None).cast("array<struct<t: bigint, x: double, y: double, traj_id: string>>")
    return keys.select(*KEYS, F.lit(False).alias("is_hot"), nothing.alias("points"))


def hot_count(status: DataFrame) -> DataFrame:
    """One row: how many partitions are hot, and how many there are."""
    return status.agg(F.count_if("is_hot").alias("n_hot"), F.count("*").alias("n_partitions"))


def cold_requested(status: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested partitions that are cold now and would have to be loaded."""
    return status.where("NOT is_hot").join(_keys_of(requested), KEYS, "left_semi").select(*KEYS)


def overlay_partitions(current: DataFrame, reloaded: DataFrame) -> DataFrame:
    """Current partitions, with the reloaded contents where a partition was reloaded.

    Points in long form. A reloaded partition that is not current does not appear.
    """
    kept = current.join(_keys_of(reloaded), KEYS, "left_anti")
    taken = reloaded.join(_keys_of(current), KEYS, "left_semi")
    return kept.unionByName(taken).select(*current.columns)


def activity_sessions(log: DataFrame, window_ms: int) -> DataFrame:
    """Periods in which a partition is hot: from a first access until idle for the window.

    Columns ``loc, block, from_ms, cold_ms, n_accesses``. An access exactly one window
    after the previous one starts a new period. Accesses less than a window apart are
    one period anyway, so they are first merged by time slots of that width, map side: a
    busy partition then has at most one row for each slot, however many accesses.
    """
    require_positive(window_ms=window_ms)
    slots = log.groupBy(*KEYS, F.floor(F.col("access_ms") / window_ms).alias("_slot")).agg(
        F.min("access_ms").alias("_first"), F.max("access_ms").alias("_last"), F.count("*").alias("_n")
    )
    by_time = Window.partitionBy(*KEYS).orderBy("_slot")
    starts = F.when(F.col("_first") - F.lag("_last").over(by_time) < window_ms, 0).otherwise(1)
    numbered = slots.withColumn("_new", starts).withColumn("_period", F.sum("_new").over(by_time))
    return (
        numbered.groupBy(*KEYS, "_period")
        .agg(
            F.min("_first").alias("from_ms"),
            (F.max("_last") + window_ms).alias("cold_ms"),
            F.sum("_n").alias("n_accesses"),
        )
        .drop("_period")
    )
