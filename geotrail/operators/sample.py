"""Reproducible samples of whole trajectories, the input of the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.params import require_positive
from geotrail.scratch import BROADCAST_ROWS


def sample_trajectory_ids(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` trajectory ids without replacement, all of them if there are fewer.

    Ids are ranked by a hash of id and seed: a fixed sample whatever the partitioning.
    """
    require_positive(sample_size=k)
    rank = F.md5(F.concat(F.col("traj_id"), F.lit(str(seed))))
    return points.select("traj_id").distinct().orderBy(rank, "traj_id").limit(k)


def sample_trajectories(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """All points of ``k`` sampled trajectories."""
    ids = sample_trajectory_ids(points, k, seed)
    kept = points.join(F.broadcast(ids) if k <= BROADCAST_ROWS else ids, "traj_id", "left_semi")
    return kept.select(*points.columns)
