"""Region of each point: adds ``loc`` to a points table of any size, without a shuffle.

The grid is arithmetic, the quadtree a chain of hash lookups in broadcast cell tables,
k-d and STR models a few comparisons with the cuts of the model, which are an array in the
plan; all of it is generated code. A model too large for that is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.functions.cells import cell, coarser
from geotrail.functions.predicates import in_bounds
from geotrail.functions.sqltext import sql
from geotrail.operators.models import SpatialModel, kd_name, str_name, walk_kdtree, walk_tiles
from geotrail.params import OUTSIDE
from geotrail.scratch import BROADCAST_ROWS

STRIDE = 3
"""Quadtree levels that one lookup covers; a region becomes at most 4**(STRIDE-1) cells."""


def assign_regions(points: DataFrame, model: SpatialModel) -> DataFrame:
    """Adds ``loc``; a point that no region holds gets ``outside``."""
    assign = {"grid": assign_grid, "quadtree": assign_quadtree, "kdtree": assign_kdtree, "strtree": assign_strtree}
    return assign[model.kind](points, model)


def _in_bounds_or_outside(loc: Column, model: SpatialModel) -> Column:
    inside = in_bounds("x", "y", model.bounds)
    return F.coalesce(F.when(inside, loc), F.lit(OUTSIDE))


def assign_grid(points: DataFrame, model: SpatialModel) -> DataFrame:
    """Two multiplications; no join."""

    def number(coord: str, low: float, size: float, n: int) -> str:
        return f"least(floor(({coord} - {sql(float(low))}) * {float(n)}D / {sql(size)}), {n - 1}L)"

    b = model.bounds
    ix, iy = number("x", b.min_x, b.width, model.shape["n"]), number("y", b.min_y, b.height, model.shape["m"])
    return points.withColumn("loc", _in_bounds_or_outside(F.expr(f"concat('g', {ix}, '_', {iy})"), model))


def assign_quadtree(points: DataFrame, model: SpatialModel) -> DataFrame:
    """Looks the point's cell up at every ``STRIDE``-th level.

    A region is entered at the next lookup level below its own, as the few cells it has
    there, so a point needs depth / STRIDE lookups and is never multiplied. The size of
    the lookup tables follows from the regions counted when the model was built; small
    ones are broadcast, a larger model is left to Spark's own join choice.
    """
    b, depth = model.bounds, model.shape["max_depth"]
    stops = sorted({min(depth, s) for s in range(STRIDE, depth + STRIDE, STRIDE)})
    regions_at = {level: n for level, n in enumerate(model.shape["regions_at"]) if n}
    stop_of = {level: next(s for s in stops if s >= level) for level in regions_at}
    cells = sum(n * 4 ** (stop_of[level] - level) for level, n in regions_at.items())

    stops = sorted(set(stop_of.values()))
    fx, fy = cell("x", b.min_x, b.width, depth), cell("y", b.min_y, b.height, depth)
    keyed = points.selectExpr("*", f"{fx} AS _fx", f"{fy} AS _fy")
    keyed = keyed.selectExpr(
        *points.columns, *(f"{coarser('_fx', depth - s)} * {2**s}L + {coarser('_fy', depth - s)} AS _key{s}" for s in stops)
    )
    for stop in stops:
        levels = [level for level, s in stop_of.items() if s == stop]
        lookup = _cells_at(model.regions.where(F.col("level").isin(levels)), stop)
        keyed = keyed.join(F.broadcast(lookup) if cells <= BROADCAST_ROWS else lookup, f"_key{stop}", "left")
    loc = _in_bounds_or_outside(F.coalesce(*(f"_loc{stop}" for stop in stops)), model)
    return keyed.select(*points.columns, loc.alias("loc"))


def _cells_at(regions: DataFrame, stop: int) -> DataFrame:
    """The cells of each region at a finer level, as one long key."""
    return (
        regions.selectExpr("loc", "ix", "iy", f"shiftleft(1L, {stop} - level) AS side")
        .selectExpr("*", "explode(sequence(0L, side - 1)) AS dx")
        .selectExpr("*", "explode(sequence(0L, side - 1)) AS dy")
        .selectExpr(f"loc AS _loc{stop}", f"(ix * side + dx) * {2**stop}L + iy * side + dy AS _key{stop}")
    )


def assign_kdtree(points: DataFrame, model: SpatialModel) -> DataFrame:
    """A subscript and a comparison for each level, in an array of cuts that is part of the plan.

    Only trees of more than 16 levels need a join, with the subtree that a point came to.
    """
    walked = walk_kdtree(points, model)
    return walked.select(*points.columns, _in_bounds_or_outside(kd_name(F.col("_tree")), model).alias("loc"))


def assign_strtree(points: DataFrame, model: SpatialModel) -> DataFrame:
    """Binary search for the slab, then for the tile in it. No point is outside."""
    if model.shape["side"] == 1:
        return points.withColumn("loc", F.lit("s0_0"))
    tiles = walk_tiles(points, model)
    return tiles.select(*points.columns, str_name(F.col("_slab"), F.col("_tile")).alias("loc"))
