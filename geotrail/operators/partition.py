"""Partition key of every point, and statistics of the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.functions.keys import time_block
from geotrail.operators.assign import assign_regions
from geotrail.operators.gather import split_evenly
from geotrail.operators.models import SpatialModel
from geotrail.operators.numbering import number_rows
from geotrail.params import OUTSIDE


def partition_points(points: DataFrame, model: SpatialModel, window: int) -> DataFrame:
    """Adds ``loc`` and ``block``. A map over the points; nothing is shuffled."""
    return assign_regions(points, model).withColumn("block", time_block(F.col("t"), window))


def cluster_points(keyed: DataFrame, n: int | None = None) -> DataFrame:
    """Brings the points of a partition together in sorted runs of about equal size."""
    return split_evenly(keyed, ["loc", "block", "t", "traj_id", "x", "y"], n, sort=["loc", "block", "t"])


def partition_counts(keyed: DataFrame) -> DataFrame:
    """Points in each partition."""
    return keyed.groupBy("loc", "block").agg(F.count("*").alias("n_points"))


def partition_profile(keyed: DataFrame) -> DataFrame:
    """One row: points, partitions, regions in use and points outside the model."""
    return partition_counts(keyed).agg(
        F.coalesce(F.sum("n_points"), F.lit(0)).alias("n_points"),
        F.count("*").alias("n_partitions"),
        F.countDistinct("loc").alias("n_locs"),
        F.coalesce(F.sum(F.when(F.col("loc") == OUTSIDE, F.col("n_points"))), F.lit(0)).alias("n_outside"),
    )


def partition_keys(keyed: DataFrame) -> DataFrame:
    """The partitions that hold points."""
    return keyed.select("loc", "block").distinct()


def rank_index_keys(keys: DataFrame) -> DataFrame:
    """Adds ``key_rank``, the place of each key in the textual order (loc, then block).

    Numbered inside each region; only region totals pass through one running sum.
    """
    return number_rows(keys, F.col("loc"), [F.col("block").cast("string")], "key_rank")


def longest_run(rows: DataFrame, key: str) -> int:
    """Most rows under one key: the size bound that ``gather`` takes."""
    row = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()
    return row["n"] or 0
