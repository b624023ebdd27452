"""Integer cells of a square grid with ``2**level`` cells on each axis."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geotrail.functions.sqltext import sql
from geotrail.params import Bounds

FINEST = 20
"""Level at which covering cells are computed before they are coarsened."""


def cell(coord: str, low: float, size: float, level: int) -> str:
    """Cell number of an in-bounds coordinate; the upper clamp only meets rounding."""
    n = 2**level
    return f"least(floor(({coord} - {sql(float(low))}) * {sql(n / size)}), {n - 1}L)"


def coarser(cell_no: str, by: str | int) -> str:
    """The cell that holds ``cell_no``, ``by`` levels up."""
    return f"shiftright({cell_no}, {by})"


def cover_cells(boxes: DataFrame, bounds: Bounds, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Pyramid of cells over each box, one row for each cell.

    Adds ``lvl``, the finest level whose cells are no smaller than the box, and for that
    level and every level above it (``a``) the cells ``ax, ay`` that the box takes there,
    about 2 x 2 whatever its size; ``lx, ly`` is the lowest of them. Coordinates are
    clamped to the bounds; clamping keeps order, so two boxes that meet share a cell at
    the coarser of their two levels.
    """

    def share(value: str, low: float, size: float) -> str:
        return f"greatest(0D, least(1D, (({value}) - {sql(float(low))}) / {sql(size)}))"

    def at_level(value: str) -> str:
        return coarser(f"least(floor({value} * {2.0**FINEST!r}D), {2**FINEST - 1}L)", f"{FINEST} - lvl")

    kept = boxes.columns
    extent = f"greatest(_fx1 - _fx0, _fy1 - _fy0, {2.0**-FINEST!r}D)"
    return (
        boxes.selectExpr(
            *kept,
            f"{share(x0, bounds.min_x, bounds.width)} AS _fx0",
            f"{share(y0, bounds.min_y, bounds.height)} AS _fy0",
            f"{share(x1, bounds.min_x, bounds.width)} AS _fx1",
            f"{share(y1, bounds.min_y, bounds.height)} AS _fy1",
        )
        .where("_fx0 <= _fx1 AND _fy0 <= _fy1")
        .selectExpr("*", f"CAST(floor(-log2({extent})) AS INT) AS lvl")
        .selectExpr(*kept, "lvl", *(f"{at_level('_f' + c)} AS _c{c}" for c in ("x0", "y0", "x1", "y1")))
        .selectExpr("*", "explode(sequence(0, lvl)) AS a")
        .selectExpr(*kept, "lvl", "a", *(f"{coarser('_c' + c, 'lvl - a')} AS _a{c}" for c in ("x0", "y0", "x1", "y1")))
        .selectExpr(*kept, "lvl", "a", "_ax0 AS lx", "_ay0 AS ly", "_ay1", "explode(sequence(_ax0, _ax1)) AS ax")
        .selectExpr(*kept, "lvl", "a", "lx", "ly", "ax", "explode(sequence(ly, _ay1)) AS ay")
    )
