"""Boolean columns of the range queries.

Arguments are column names (or SQL text) and numbers. Plain arithmetic: everything
stays in generated code, and closed ranges reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geotrail.functions.sqltext import sql
from geotrail.params import Bounds

Value = str | int | float


def in_circle(x: str, y: str, cx: Value, cy: Value, r: Value) -> Column:
    """Closed disc."""
    dx, dy, r = f"({x} - {sql(cx)})", f"({y} - {sql(cy)})", sql(r)
    return F.expr(f"{r} >= 0 AND {dx} * {dx} + {dy} * {dy} <= {r} * {r}")


def in_box(x: str, y: str, x0: Value, y0: Value, x1: Value, y1: Value) -> Column:
    """Closed rectangle."""
    return F.expr(f"{x} BETWEEN {sql(x0)} AND {sql(x1)} AND {y} BETWEEN {sql(y0)} AND {sql(y1)}")


def in_time(t: str, ta: Value, tb: Value) -> Column:
    """Closed interval."""
    return F.expr(f"{t} BETWEEN {sql(ta)} AND {sql(tb)}")


def in_bounds(x: str, y: str, bounds: Bounds) -> Column:
    """Half-open bounds of a model."""
    return F.expr(within(x, y, x, y, bounds))


def within(x0: str, y0: str, x1: str, y1: str, b: Bounds) -> str:
    """SQL text: a closed rectangle lies in the half-open bounds."""
    low_x, low_y, high_x, high_y = (sql(float(v)) for v in (b.min_x, b.min_y, b.max_x, b.max_y))
    return f"({x0} >= {low_x} AND {x1} < {high_x} AND {y0} >= {low_y} AND {y1} < {high_y})"


def circle_touches_region(cx: Value, cy: Value, r: Value, bounds: Bounds, region: str = "") -> Column:
    """Circle against the padded box in columns ``x0, y0, x1, y1`` of a regions table."""
    cx, cy, r, pad = sql(cx), sql(cy), sql(r), sql(bounds.pad)
    dx = f"greatest({region}x0 - {pad} - {cx}, 0D, {cx} - ({region}x1 + {pad}))"
    dy = f"greatest({region}y0 - {pad} - {cy}, 0D, {cy} - ({region}y1 + {pad}))"
    return F.expr(f"{r} >= 0 AND {dx} * {dx} + {dy} * {dy} <= {r} * {r}")


def box_touches_region(x0: Value, y0: Value, x1: Value, y1: Value, bounds: Bounds, region: str = "") -> Column:
    """Rectangle against the padded box of a region."""
    x0, y0, x1, y1, pad = sql(x0), sql(y0), sql(x1), sql(y1), sql(bounds.pad)
    return F.expr(
        f"{x0} <= {x1} AND {y0} <= {y1}"
        f" AND {region}x0 - {pad} <= {x1} AND {x0} <= {region}x1 + {pad}"
        f" AND {region}y0 - {pad} <= {y1} AND {y0} <= {region}y1 + {pad}"
    )
