"""Points, workloads and logs that the checked queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.keys import epoch_offset
from geotrail.params import Bounds, BoxQuery, CircleQuery

ORIGIN = "2024-01-01 00:00:00"
ORIGIN_US = 1_704_067_200_000_000
BOUNDS = Bounds(0.0, 0.0, 1024.0, 1024.0)
WINDOW = 20_000
CAPACITY = 200
MAX_DEPTH = 8
SMALL_CAPACITY = 4
PARTITIONS = 7
CHUNK = 100
GRID = (16, 8)
SAMPLE = 100
SEED = 7
CIRCLE = CircleQuery(100.0, 500.0, 100.0, 200_000, 900_000)
BOX = BoxQuery(50.0, 400.0, 150.0, 600.0, 200_000, 900_000)
ACTIVE_MS = 86_400_000
SESSION_MS = 21_600_000
STREAM_MS = 3_600_000
TICK_MS = 10_000
DELAY_MS = 60_000
NOW_MS = 1_500_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def st_points(events: DataFrame, *more: Column) -> DataFrame:
    """Events as points: x is skewed, y is even, t counts seconds."""
    return events.select(
        F.col("user_id").cast("string").alias("traj_id"),
        (F.col("value") * 2.0).alias("x"),
        (((F.col("event_id") * 7919) % 100000).cast("double") / 100.0).alias("y"),
        epoch_offset(F.col("ts"), ORIGIN).alias("t"),
        "event_id",
        *more,
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st_points(events(spark, sf_dir))


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circle around every fiftieth point: the size of the workload follows the data."""
    return _around(points(spark, sf_dir).where("event_id % 50 = 0"))


def every_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circle around every point."""
    return _around(points(spark, sf_dir))


def open_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circles with intervals that have no ends."""
    return circles(spark, sf_dir).withColumns({"ta": F.lit(-(2**63)), "tb": F.lit(2**63 - 1)})


def hot_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circles, all within a square of 50 at the crowded end of x, with one interval."""
    asked = {"x": F.expr("20 + query_id div 50 % 50"), "y": F.expr("200 + query_id div 2500 % 50"), "ta": F.lit(0), "tb": F.lit(400_000)}
    kinds = {"x": "double", "y": "double", "ta": "bigint", "tb": "bigint"}
    return circles(spark, sf_dir).withColumns({c: v.cast(kinds[c]) for c, v in asked.items()})


def _around(p: DataFrame) -> DataFrame:
    return p.selectExpr(
        "event_id AS query_id",
        "x",
        "y",
        "CAST(2 + event_id div 50 % 50 AS DOUBLE) AS r",
        "t AS ta",
        "t + 1000 + (event_id * 7919) % 1000000 AS tb",
        "t * 1000 AS issued_ms",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounding boxes of the circles."""
    return circles(spark, sf_dir).selectExpr(
        "query_id", "x - r AS x0", "y - r AS y0", "x + r AS x1", "y + r AS y1", "ta", "tb", "issued_ms"
    )


def far_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circles, and each once more far away from every point."""
    near = circles(spark, sf_dir)
    far = near.withColumns({"query_id": -F.col("query_id") - 1, "y": F.col("y") + 5000.0})
    return near.unionByName(far)


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as completion times of queries."""
    return events(spark, sf_dir).select(finished_us(F.col("ts")).alias("finished_us")).selectExpr(
        "finished_us div 1000 AS finished_ms"
    )


def finished_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp read as UTC.

    Counted from ``ORIGIN``: Spark subtracts through the session zone, whose offset in 1970
    may have been another one.
    """
    since_origin = F.timestamp_diff("MICROSECOND", F.lit(ORIGIN).cast("timestamp_ntz"), ts)
    return since_origin + F.lit(ORIGIN_US)
