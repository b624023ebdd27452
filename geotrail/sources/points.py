"""Trajectory files in and out: text lines, nested rows and the long table of points.

Any Hadoop URI works as a path. Schemas are given, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.params import require_positive, require_text

POINTS_SCHEMA = "traj_id string, x double, y double, t bigint"
NESTED_SCHEMA = "traj_id string, points array<struct<t: bigint, x: double, y: double>>"


def read_points(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = POINTS_SCHEMA) -> DataFrame:
    """Long form from Parquet, ORC, JSON or CSV."""
    require_text(path=path)
    return spark.read.schema(schema).format(fmt).load(path)


def read_trajectories(
    spark: SparkSession, path: str, fmt: str = "text", partitions: int | None = None, decimals: int | None = None
) -> DataFrame:
    """Nested form from text lines ``id;x y t;x y t;...`` or from nested rows.

    ``partitions`` sets the number of Spark partitions, ``decimals`` rounds coordinates.
    """
    require_text(path=path)
    if fmt == "text":
        nested = parse_trajectory_lines(spark.read.text(path), decimals)
    else:
        nested = spark.read.schema(NESTED_SCHEMA).format(fmt).load(path)
    return nested if partitions is None else set_partitions(nested, partitions)


def parse_trajectory_lines(lines: DataFrame, decimals: int | None = None) -> DataFrame:
    """Trajectories from a column ``value`` of text lines. Blank lines are skipped."""

    def number(text: Column) -> Column:
        value = text.cast("double")
        return value if decimals is None else F.round(value, decimals)

    def point(text: Column) -> Column:
        parts = F.split(F.trim(text), r"\s+")
        return F.struct(
            parts[2].cast("bigint").alias("t"), number(parts[0]).alias("x"), number(parts[1]).alias("y")
        )

    fields = F.split("value", ";")
    coordinates = F.filter(F.slice(fields, 2, F.size(fields)), lambda s: F.trim(s) != "")
    return lines.where(F.trim("value") != "").select(
        F.trim(fields[0]).alias("traj_id"), F.transform(coordinates, point).alias("points")
    )


def format_trajectories(nested: DataFrame) -> DataFrame:
    """Text lines of trajectories, the form ``read_trajectories`` takes."""

    def text(p: Column) -> Column:
        return F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["t"].cast("string"))

    points = F.array_join(F.transform("points", text), ";")
    return nested.select(F.concat_ws(";", "traj_id", points).alias("value"))


def flatten_points(nested: DataFrame) -> DataFrame:
    """Long form of nested rows."""
    return nested.selectExpr("traj_id", "inline(points)").select("traj_id", "x", "y", "t")


def replicate(points: DataFrame, n: int) -> DataFrame:
    """``n`` copies of a data set under new ids ``traj_id#k``, k from 0."""
    require_positive(n=n)
    copies = points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return copies.withColumn("traj_id", F.concat_ws("#", "traj_id", F.col("_k").cast("string"))).drop("_k")


def set_partitions(df: DataFrame, n: int, *by: str) -> DataFrame:
    """``n`` Spark partitions, by ranges of the given columns if there are any."""
    require_positive(partitions=n)
    return df.repartitionByRange(n, *by) if by else df.repartition(n)
