"""The partitioned store: keyed points as Parquet, with the model saved beside them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrail.operators.candidates import fetch_partitions
from geotrail.operators.models import SpatialModel
from geotrail.operators.partition import cluster_points, longest_run, partition_counts
from geotrail.params import Bounds, require_positive, require_text

LAYOUTS = ("clustered", "dirs")


@dataclass(frozen=True)
class Store:
    """Stored points with ``loc, block``; their model, window and partition counts.

    ``longest`` bounds the points of one trajectory, ``fullest`` those of a partition.
    """

    points: DataFrame
    model: SpatialModel
    window: int
    counts: DataFrame
    longest: int
    fullest: int


def write_store(
    keyed: DataFrame,
    model: SpatialModel,
    window: int,
    path: str,
    layout: str = "clustered",
    partitions: int | None = None,
) -> None:
    """Write keyed points once, sorted by partition.

    ``clustered`` keeps whole ranges of partitions in one file and prunes by row-group
    statistics; it has as many files as tasks however many partitions there are.
    ``dirs`` makes a directory for each partition, for up to some ten thousand of them.
    """
    require_text(path=path)
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, got {layout}")
    if partitions is not None:
        require_positive(partitions=partitions)
    spark = keyed.sparkSession
    writer = cluster_points(keyed, partitions).write
    if layout == "dirs":
        writer = writer.partitionBy("loc", "block")
    writer.parquet(f"{path}/points")

    points = spark.read.schema(keyed.schema).parquet(f"{path}/points")
    partition_counts(points).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    model.regions.write.parquet(f"{path}/regions")
    if model.cuts is not None:
        model.cuts.write.parquet(f"{path}/cuts")
    b = model.bounds
    settings = {
        "kind": model.kind,
        "bounds": [b.min_x, b.min_y, b.max_x, b.max_y],
        "shape": model.shape,
        "has_cuts": model.cuts is not None,
        "window": window,
        "longest": longest_run(points, "traj_id"),
        "fullest": counts.agg(F.max("n_points")).first()[0] or 0,
        "points": json.loads(keyed.schema.json()),
        "regions": json.loads(model.regions.schema.json()),
    }
    spark.range(0, 1, 1, 1).select(F.lit(json.dumps(settings)).alias("value")).write.text(f"{path}/settings")


def read_store(spark: SparkSession, path: str) -> Store:
    """Open a store. Schemas come from its settings, so key columns keep their types."""
    require_text(path=path)
    settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])

    def table(name: str, schema: dict) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{path}/{name}")

    model = SpatialModel(
        settings["kind"],
        Bounds(*settings["bounds"]),
        table("regions", settings["regions"]),
        settings["shape"],
        spark.read.parquet(f"{path}/cuts") if settings["has_cuts"] else None,
    )
    return Store(
        table("points", settings["points"]),
        model,
        settings["window"],
        spark.read.schema("loc string, block bigint, n_points bigint").parquet(f"{path}/counts"),
        settings["longest"],
        settings["fullest"],
    )


def read_partitions(store: Store, keys: DataFrame) -> DataFrame:
    """Points of the listed partitions only."""
    return fetch_partitions(store.points, keys)
