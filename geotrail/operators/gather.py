"""Nested rows: points collected under a key, in time order, in bounded slices."""

from __future__ import annotations

from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.operators.numbering import totals_before
from geotrail.params import require_positive
from geotrail.scratch import BROADCAST_ROWS, publish, publish_with_facts

MAX_POINTS = 1_000_000
"""Most points that one nested row holds."""

SALTS = 4096
WHOLE: WeakKeyDictionary[DataFrame, list[str]] = WeakKeyDictionary()
"""Nested tables that are known to have one row for each key, and these keys; tables made from them are others."""


def split_evenly(df: DataFrame, order: Sequence[str], n: int | None = None, sort: Sequence[str] = ()) -> DataFrame:
    """Range-partitions by ``order``; even one key, or copies of one row, spread.

    A salt separates copies. It is the place of a row in its task once the task has put
    its rows in an order of content (by hash first, the cheapest to compare), so a repeated
    task deals the same rows to the same partitions. The result is sorted by ``sort``,
    by default by all columns.
    """
    order = list(order)
    every = order + [c for c in df.columns if c not in order]
    salted = df.sortWithinPartitions(F.xxhash64(*every), *every).withColumn(
        "_salt", F.monotonically_increasing_id() % SALTS
    )
    ranged = salted.repartitionByRange(*([n] if n else []), *every, "_salt")
    return ranged.drop("_salt").sortWithinPartitions(*(sort or every))


def gather(
    rows: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    max_points: int = MAX_POINTS,
    longest: int | None = None,
) -> DataFrame:
    """One row ``keys, part, points`` for each key; ``points`` is sorted by ``fields``.

    A key with more than ``max_points`` rows becomes several rows: slices that follow
    each other in the order of ``part``, none above ``max_points``, nothing dropped.
    Parts are numbered from 0 by the rank of a row among the rows of its key, so they
    follow from the data alone. Unless ``longest`` is passed, a known bound of rows for
    each key such as the one kept in a store, keys are counted first, map side and without
    the other columns; only the rows of large keys are written, to be ranked.
    """
    require_positive(max_points=max_points)
    keys, fields = list(keys), list(fields)
    points = F.array_sort(F.collect_list(F.struct(*fields))).alias("points")

    def whole(df: DataFrame) -> DataFrame:
        nested = df.groupBy(*keys).agg(points)
        return nested.select(*keys, F.lit(0).cast("bigint").alias("part"), "points")

    if longest is not None and longest <= max_points:
        return whole(rows)
    rows = rows.select(*dict.fromkeys(keys + fields))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max_points).select(*keys)
    large, found = publish_with_facts(counted, "large-keys", F.count(F.lit(1)).alias("n"))
    if not found["n"]:
        return whole(rows)
    large = F.broadcast(large) if found["n"] <= BROADCAST_ROWS else large
    # null keys are keys: compared so that null equals null
    same = [F.col("_r." + k).eqNullSafe(F.col("_l." + k)) for k in keys]
    slices = _ranked(rows.alias("_r").join(large.alias("_l"), same, "left_semi").select(*keys, *fields), keys, fields)
    slices = slices.withColumn("part", F.expr(f"_rank div {max_points}")).groupBy(*keys, "part").agg(points)
    return whole(rows.alias("_r").join(large.alias("_l"), same, "left_anti")).unionByName(slices)


def _ranked(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Adds ``_rank``, from 0, of each row among those of its key, in the order of ``fields``.

    The rows are ranged into tasks and written with their task and place; a row's rank is
    its place among the rows of its key in the task, after those of earlier tasks.
    """
    ranged = split_evenly(rows, keys + fields)
    placed = publish(
        ranged.withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranked"
    )
    runs = placed.groupBy(*keys, "_task").agg(F.min("_place").alias("_from"), F.count(F.lit(1)).alias("_n"))
    runs = totals_before(runs, ["_task"], "_n", by=keys)
    rank = F.col("_place") - F.col("_from") + F.col("before")
    same = [F.col("_l." + k).eqNullSafe(F.col("_r." + k)) for k in [*keys, "_task"]]
    met = placed.alias("_l").join(runs.alias("_r"), same)
    return met.select(*(F.col("_l." + c) for c in [*keys, *fields]), rank.alias("_rank"))


def number_in_order(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``, the place of each row in the order, from 1.

    Rows are ranged into tasks by counted boundaries and written with their task and place;
    a number is the rows of earlier tasks and the place in its own. One moment that all rows
    share is many tasks like any other.
    """
    ranged = split_evenly(rows, order)
    placed = publish(ranged.withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "numbered")
    sizes = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_from"))
    starts = totals_before(sizes, ["_task"], "_n").select("_task", "_from", "before")
    number = (F.col("_place") - F.col("_from") + F.col("before") + 1).cast("bigint")
    return placed.join(F.broadcast(starts), "_task").select(*rows.columns, number.alias(name))


def build_trajectories(hits: DataFrame, max_points: int = MAX_POINTS, longest: int | None = None) -> DataFrame:
    """Hit points back to trajectories: ``query_id, traj_id, part, points``.

    All visits of a trajectory come together under its id, sorted by time, then x, y.
    """
    return gather(hits, ["query_id", "traj_id"], ["t", "x", "y"], max_points, longest)


def gather_partitions(keyed: DataFrame, max_points: int = MAX_POINTS, longest: int | None = None) -> DataFrame:
    """Points of each partition: ``loc, block, part, points``."""
    return gather(keyed, ["loc", "block"], ["t", "x", "y", "traj_id"], max_points, longest)


def summarize(nested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flat form of nested rows: number of points, first and last time of each key.

    Rows that are known to be one for each key have nothing to be put together with.
    """
    if WHOLE.get(nested) == list(keys):
        ends = F.col("points")[0]["t"].alias("t_min"), F.element_at("points", -1)["t"].alias("t_max")
        return nested.select(*keys, F.size("points").cast("bigint").alias("n_points"), *ends)
    return nested.groupBy(*keys).agg(
        F.sum(F.size("points")).alias("n_points"),
        F.min(F.col("points")[0]["t"]).alias("t_min"),
        F.max(F.element_at("points", -1)["t"]).alias("t_max"),
    )
