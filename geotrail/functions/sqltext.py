"""Numbers as SQL text, for expressions that are shorter as text than as calls."""

from __future__ import annotations

import math


def sql(value: str | int | float) -> str:
    """A column name as it is, a number as a BIGINT or DOUBLE literal."""
    if isinstance(value, str):
        return value
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"DOUBLE('{value}')"
    return f"{int(value)}L"
