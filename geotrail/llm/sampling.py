"""Bounded samples of rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINE = 1 << 30


MAX_GROUPS = 64


def bounded_sample(
    rows: DataFrame, group: str, key: Column, per_group: int, max_chars: int, size: Column, max_groups: int = MAX_GROUPS
) -> DataFrame:
    """At most ``per_group`` rows and ``max_chars`` of ``size`` of each group, by the order of ``key``'s hash.

    Of more than ``max_groups`` groups, those with the most rows, ties by name.
    A row above ``max_chars`` is left out before sizes are added up, so it costs no other
    row its place; of a group that has only such rows the smallest one is taken. A first
    pass counts the groups and admits about twice the share that is needed, so the ordered
    window never sees more than a bounded number of rows of a group.
    """
    sized = rows.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))
    fits = F.col("_size") <= max_chars
    facts = sized.groupBy(group).agg(F.count_if(fits).alias("n"), F.min("_size").alias("least"), F.count(F.lit(1)).alias("every"))
    facts = facts.orderBy(F.desc("every"), group).limit(max_groups).select(group, "n", "least").collect()
    admit = F.lit(False)
    for name, n, least in facts:
        share = F.col("_order") < F.lit(int(min(1.0, 2 * per_group / n) * FINE)) if n else F.col("_size") == least
        admit = admit | ((F.col(group) == F.lit(name)) & (fits if n else F.lit(True)) & share)
    hashed = sized.withColumn("_order", F.pmod(F.xxhash64(key), F.lit(FINE)))
    order = Window.partitionBy(group).orderBy("_order", key)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    kept = hashed.where(admit).withColumn("_rank", F.row_number().over(order)).withColumn("_chars", F.sum("_size").over(run))
    chosen = (F.col("_rank") <= per_group) & ((F.col("_chars") <= max_chars) | (F.col("_rank") == 1))
    return kept.where(chosen).drop("_order", "_rank", "_chars", "_size")
