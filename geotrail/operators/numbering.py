"""Row numbers and running values over a whole table without a one-task window.

A window without ``partitionBy`` moves every row to one task. Here rows are numbered
inside ordered buckets, and only the bucket totals pass through one running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals_before(totals: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the earlier rows.

    For tables with one row for each bucket, region, file split or day.
    """
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("before", F.coalesce(F.sum(value).over(window), F.lit(0)))


def number_rows(df: DataFrame, bucket: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Numbers from 1 in the order (bucket, order); ``bucket`` must not contradict ``order``."""
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = totals_before(totals, ["_bucket"], "_n").select("_bucket", "before")
    window = Window.partitionBy("_bucket").orderBy(*order)
    return (
        rows.join(before, "_bucket")
        .withColumn(name, (F.row_number().over(window) + F.col("before")).cast("bigint"))
        .drop("_bucket", "before")
    )


def number_within(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Numbers from 0 inside each group of ``by``, in buckets like ``number_rows``."""
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = totals_before(totals, ["_bucket"], "_n", by).select(*by, "_bucket", "before")
    window = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = rows.join(before, [*by, "_bucket"])
    return numbered.withColumn(name, F.row_number().over(window) - 1 + F.col("before")).drop("_bucket", "before")
