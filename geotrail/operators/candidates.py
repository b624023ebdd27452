"""Filter step: which partitions a query can have hits in.

A workload is a table of circles ``query_id, x, y, r, ta, tb`` or of boxes
``query_id, x0, y0, x1, y1, ta, tb``, with unique ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.functions.cells import cover_cells
from geotrail.functions.keys import div
from geotrail.functions.predicates import box_touches_region, circle_touches_region, within
from geotrail.operators.dealing import ROWS, WORK, spread_join
from geotrail.operators.models import SpatialModel, model_regions
from geotrail.params import OUTSIDE, require_positive
from geotrail.scratch import BROADCAST_ROWS

SPAN = 8
"""Most blocks (or coarser blocks) into which a join unrolls one interval, about."""

SCALES = 8
CELLS_OF_REGION = 48
"""Cells of one region in the pyramid, at its own level and above, at most about."""


def is_circles(workload: DataFrame) -> bool:
    return "r" in workload.columns


def shape_columns(workload: DataFrame) -> list[str]:
    return ["x", "y", "r"] if is_circles(workload) else ["x0", "y0", "x1", "y1"]


def valid_queries(workload: DataFrame) -> DataFrame:
    """Drops queries that cannot have a hit: reversed interval, negative extent.

    The comparison also lets Spark prune partitions by the workload at run time.
    """
    if is_circles(workload):
        return workload.where("ta <= tb AND r >= 0")
    return workload.where("ta <= tb AND x0 <= x1 AND y0 <= y1")


def extent(workload: DataFrame) -> tuple[str, str, str, str]:
    """Bounding rectangle of each query, as SQL text."""
    if is_circles(workload):
        return "(x - r)", "(y - r)", "(x + r)", "(y + r)"
    return "x0", "y0", "x1", "y1"


def block_range(ta: Column, tb: Column, window: int) -> Column:
    """Struct ``first_block, last_block`` of an interval of any length; null if it is reversed."""
    require_positive(window=window)
    return F.when(ta <= tb, F.struct(div(ta, window).alias("first_block"), div(tb, window).alias("last_block")))


def blocks_for_interval(ta: Column, tb: Column, window: int) -> Column:
    """Array of the blocks from ``ta`` to ``tb``; empty if the interval is reversed.

    One element for each block: for intervals of known length. ``block_range`` says the
    same of any interval in two numbers.
    """
    require_positive(window=window)
    none = F.array().cast("array<bigint>")
    return F.when(ta <= tb, F.sequence(div(ta, window), div(tb, window))).otherwise(none)


def candidate_regions(workload: DataFrame, model: SpatialModel, broadcast_rows: int = BROADCAST_ROWS, work: int = WORK, rows: int = ROWS) -> DataFrame:
    """Workload rows with each region they touch: ``loc`` is added.

    Instead of testing every query against every region, both are put on a pyramid of
    cells, at the level of their own size and the levels above. Two shapes that meet
    share a cell at the coarser of their levels, so an equi join on cells finds all
    pairs; the exact test keeps the true ones. A pair that shares several cells is taken
    at the lowest of them only: no pair comes twice and nothing has to be deduplicated.

    All queries meet at the coarsest cells. A model of few regions is broadcast, so queries
    stay where they are; with more than ``broadcast_rows`` region cells, by the size of the
    model, both sides are shuffled and the cells where many rows meet are joined as grids.
    """
    b = model.bounds
    columns, shape = workload.columns, shape_columns(workload)
    keys = ["kind", "a", "ax", "ay"]

    # kind 0: the query's own cells against regions in or below them;
    # kind 1: cells above the query against the regions' own cells;
    # kind 2: queries that leave the bounds against the region of outside points
    queries = valid_queries(workload)
    query_cells = cover_cells(queries, b, *extent(queries)).selectExpr(
        *columns,
        *keys[1:],
        "lx",
        "ly",
        f"""explode(CASE WHEN a = 0 AND NOT {within(*extent(queries), b)} THEN array(int(a != lvl), 2)
                         ELSE array(int(a != lvl)) END) AS kind""",
    )
    padded = (f"x0 - {b.pad!r}D", f"y0 - {b.pad!r}D", f"x1 + {b.pad!r}D", f"y1 + {b.pad!r}D")
    region = ["loc", "x0 AS _rx0", "y0 AS _ry0", "x1 AS _rx1", "y1 AS _ry1", "lx AS _rlx", "ly AS _rly"]
    region_cells = cover_cells(model.regions.select("loc", "x0", "y0", "x1", "y1"), b, *padded).selectExpr(
        *region, *keys[1:], "explode(CASE WHEN a = lvl THEN array(0, 1) ELSE array(0) END) AS kind"
    )
    nowhere = ["0D AS _rx0", "0D AS _ry0", "0D AS _rx1", "0D AS _ry1", "0L AS _rlx", "0L AS _rly"]
    outside = workload.sparkSession.range(1).selectExpr(
        f"'{OUTSIDE}' AS loc", *nowhere, "0 AS a", "0L AS ax", "0L AS ay", "2 AS kind"
    )
    touches = circle_touches_region if is_circles(workload) else box_touches_region
    lowest = F.expr("ax = greatest(lx, _rlx) AND ay = greatest(ly, _rly)")
    region_cells = region_cells.unionByName(outside)
    if model_regions(model) * CELLS_OF_REGION <= broadcast_rows:
        pairs = query_cells.join(F.broadcast(region_cells), keys)
    else:
        pairs = spread_join(query_cells, region_cells, keys, work, rows)
    return pairs.where(lowest & ((F.col("kind") == 2) | touches(*shape, b, "_r"))).select(*columns, "loc")


def candidate_ranges(workload: DataFrame, model: SpatialModel, window: int) -> DataFrame:
    """Partitions of each query as runs of blocks: the workload, ``loc, first_block, last_block``.

    A run is one row however long it is, so intervals may be open.
    """
    run = block_range(F.col("ta"), F.col("tb"), window)
    return candidate_regions(workload, model).withColumn("_run", run).select(*workload.columns, "loc", "_run.*")


def candidate_partitions(workload: DataFrame, model: SpatialModel, window: int) -> DataFrame:
    """Partition keys of each query, listed: ``query_id, loc, block`` and the workload columns.

    Lists every block of an interval, also those without points, so intervals must be of
    known length; ``candidate_ranges`` and ``existing_candidates`` take any.
    """
    regions = candidate_regions(workload, model)
    return regions.withColumn("block", F.explode(blocks_for_interval(F.col("ta"), F.col("tb"), window)))


def existing_candidates(workload: DataFrame, model: SpatialModel, window: int, counts: DataFrame) -> DataFrame:
    """Like ``candidate_partitions``, but only partitions that hold points.

    ``counts`` has one row ``loc, block`` for each partition, as a store keeps it. Nothing is
    unrolled: a run of blocks meets the blocks that exist by an equi join on blocks of its
    own scale, a few for each run, and the run's ends are tested on what meets.
    """
    require_positive(window=window)
    keys = candidate_join_keys(workload, model, window).withColumnRenamed("block", "_block")
    present, on = at_scales(counts.select("loc", "block"), list(range(SCALES)))
    pairs = spread_join(keys, present, on)
    return pairs.where(f"block BETWEEN ta div {window}L AND tb div {window}L").select(*workload.columns, "loc", "block")


def scaled_block(block: str, scale: str) -> str:
    """SQL text: block number in units of ``SPAN ** scale`` blocks, which keeps their order; 0 at the top scale."""
    cases = " ".join(f"WHEN {s} THEN {block} div {SPAN**s}" for s in range(1, SCALES - 1))
    return f"CASE {scale} WHEN 0 THEN {block} {cases} ELSE 0L END"


def at_scales(keyed: DataFrame, scales: list[int]) -> tuple[DataFrame, list[str]]:
    """Rows with ``loc, block`` at the time scales of a workload, and the join columns."""
    if scales == [0]:
        return keyed, ["loc", "block"]
    used = F.explode(F.array(*(F.lit(s) for s in scales)))
    return keyed.withColumn("scale", used).withColumn("_block", F.expr(scaled_block("block", "scale"))), [
        "loc",
        "scale",
        "_block",
    ]


def candidate_join_keys(workload: DataFrame, model: SpatialModel, window: int, coarser: int = 0) -> DataFrame:
    """Like ``candidate_partitions``, with long intervals in coarser blocks.

    A query over very many blocks would become that many rows; it gets the finest
    ``scale`` at which it takes about ``SPAN`` rows for each region. At the top scale all
    blocks are one, so an open-ended interval is one row for each region. The interval
    itself is tested on the points, so the answer does not depend on the scale, which
    ``coarser`` raises.
    """
    require_positive(window=window)
    first, last = f"(ta div {window}L)", f"(tb div {window}L)"
    # a difference that does not fit is null and falls through to the top scale
    cases = " ".join(f"WHEN try_subtract({last}, {first}) < {SPAN ** (s + 1)}L THEN {s}" for s in range(SCALES - 1))
    return (
        candidate_regions(workload, model)
        .selectExpr("*", f"least(CASE {cases} ELSE {SCALES - 1} END + {coarser}, {SCALES - 1}) AS scale")
        .selectExpr("*", f"explode(sequence({scaled_block(first, 'scale')}, {scaled_block(last, 'scale')})) AS block")
    )


def fetch_partitions(points: DataFrame, keys: DataFrame) -> DataFrame:
    """Points of the listed partitions. A listed partition without points adds nothing."""
    kept = points.join(keys.select("loc", "block").distinct(), ["loc", "block"], "left_semi")
    return kept.select(*points.columns)
