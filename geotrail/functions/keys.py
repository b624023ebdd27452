"""Time blocks and the textual partition key ``oid&loc&block``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.params import require_positive

OID = "1"
"""First part of every key: one bucket holds all objects."""


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def time_block(t: Column, window: int) -> Column:
    """Number of the time block that holds ``t``."""
    require_positive(window=window)
    return div(t, window)


def index_key(loc: Column, block: Column) -> Column:
    """Key text of a partition; fails on a null part instead of dropping it."""
    return F.when(
        loc.isNull() | block.isNull(),
        F.raise_error(F.lit("a partition key has no null parts")),
    ).otherwise(F.concat_ws("&", F.lit(OID), loc, block.cast("string")))


def parse_index_key(key: Column) -> list[Column]:
    """Typed columns ``oid, loc, block`` of a key text."""
    parts = F.split(key, "&")
    return [
        parts[0].alias("oid"),
        parts[1].alias("loc"),
        parts[2].cast("bigint").alias("block"),
    ]


def order_index_keys(keys: DataFrame) -> DataFrame:
    """Sort ``oid, loc, block`` rows as texts, so that block "10" comes before "9"."""
    return keys.orderBy("oid", "loc", F.col("block").cast("string"))


def epoch_offset(ts: Column, origin: str) -> Column:
    """Whole seconds from the zone-free timestamp ``origin`` to ``ts``."""
    return F.timestamp_diff("SECOND", F.lit(origin).cast("timestamp_ntz"), ts)
