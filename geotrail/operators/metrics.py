"""Throughput of a query run: counter samples, differences and coarser buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.keys import div
from geotrail.operators.numbering import totals_before
from geotrail.params import require_positive

TICK_MS = 10_000
TICKS_PER_BUCKET = 6
DAY_MS = 86_400_000
CHUNK = 1_024
"""Values of a series in one stored row."""


def query_counter(finished: DataFrame, tick_ms: int = TICK_MS) -> DataFrame:
    """Counter sampled at the end of each tick: ``tick_ms, finished, counter``.

    Input: ``finished_ms`` of each query. Ticks run from the first to the last query and
    include the empty ones. Queries are counted map side; running sums are taken inside
    a day, and only day totals pass through one running sum.
    """
    require_positive(tick_ms=tick_ms)
    ticks_per_day = max(1, DAY_MS // tick_ms)
    counts = (
        finished.groupBy(F.floor(F.col("finished_ms") / tick_ms).alias("tick"))
        .agg(F.count("*").alias("n"))
        .withColumn("day", F.floor(F.col("tick") / ticks_per_day))
    )
    span = counts.agg(F.min("tick").alias("first"), F.max("tick").alias("last")).where("first IS NOT NULL")
    days = span.withColumn(
        "day", F.explode(F.sequence(F.floor(F.col("first") / ticks_per_day), F.floor(F.col("last") / ticks_per_day)))
    )
    first_of_day = F.greatest(F.col("first"), F.col("day") * ticks_per_day)
    last_of_day = F.least(F.col("last"), (F.col("day") + 1) * ticks_per_day - 1)
    ticks = days.select("day", F.explode(F.sequence(first_of_day, last_of_day)).alias("tick"))
    per_tick = ticks.join(counts, ["day", "tick"], "left").select("day", "tick", F.coalesce("n", F.lit(0)).alias("n"))
    day_totals = per_tick.groupBy("day").agg(F.sum("n").alias("n"))
    before = totals_before(day_totals, ["day"], "n").select("day", "before")
    in_day = Window.partitionBy("day").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_tick.join(before, "day").select(
        ((F.col("tick") + 1) * tick_ms).alias("tick_ms"),
        F.col("n").alias("finished"),
        (F.sum("n").over(in_day) + F.col("before")).alias("counter"),
    )


def throughput(samples: DataFrame, slice_size: int) -> DataFrame:
    """Counter minus the previous counter of the run: ``run, seq, throughput``.

    The first previous counter is 0. Samples ``run, seq, counter`` are compared inside
    slices of ``slice_size`` sequence units; the last counter of a slice is handed on to
    the next one, so one long run is not the work of one task.
    """
    require_positive(slice_size=slice_size)
    sliced = samples.withColumn("_slice", F.floor(F.col("seq") / slice_size))
    handed_on = (
        sliced.groupBy("run", "_slice")
        .agg(F.max_by("counter", "seq").alias("_last"))
        .withColumn("_before", F.lag("_last", 1, 0).over(Window.partitionBy("run").orderBy("_slice")))
        .drop("_last")
    )
    previous = F.lag("counter").over(Window.partitionBy("run", "_slice").orderBy("seq"))
    return sliced.join(handed_on, ["run", "_slice"]).select(
        "run", "seq", (F.col("counter") - F.coalesce(previous, F.col("_before"))).alias("throughput")
    )


def throughput_rollup(series: DataFrame, size: int = TICKS_PER_BUCKET) -> DataFrame:
    """Sums of ``size`` values: ``series, bucket, total`` from ``series, pos, v``.

    The leading value is replaced by a 0 (bucket -1); a short last bucket is kept.
    """
    require_positive(size=size)
    sums = (
        series.where("pos >= 1")
        .groupBy("series", div(F.col("pos").cast("bigint") - 1, size).alias("bucket"))
        .agg(F.sum("v").alias("total"))
    )
    leading = series.select("series").distinct().select(
        "series", F.lit(-1).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("total")
    )
    return leading.unionByName(sums)


def series_chunks(series: DataFrame, size: int = CHUNK) -> DataFrame:
    """Values in stored chunks: ``series, chunk, items`` from ``series, pos, v``.

    A chunk holds the positions ``chunk * size`` up to the next chunk in order, null where there
    is no value; a series grows by rows, not by longer arrays. ``chunk_values`` turns it back.
    """
    require_positive(size=size)
    at = series.select("series", div(F.col("pos"), size).alias("chunk"), (F.col("pos") % size).cast("int").alias("_at"), "v")
    held = F.map_from_entries(F.collect_list(F.struct("_at", "v")))
    return at.groupBy("series", "chunk").agg(
        F.transform(F.sequence(F.lit(0), F.max("_at")), lambda k: F.try_element_at(held, k)).alias("items")
    )


def chunk_values(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """``series, pos, v`` of stored chunks."""
    require_positive(size=size)
    values = chunks.select("series", "chunk", F.posexplode("items").alias("_at", "v")).where("v IS NOT NULL")
    return values.select("series", (F.col("chunk") * size + F.col("_at")).alias("pos"), "v")


def rollup_chunks(chunks: DataFrame, size: int = TICKS_PER_BUCKET, chunk_size: int = CHUNK) -> DataFrame:
    """``throughput_rollup`` of stored chunks.

    Every chunk is summed by itself, without a shuffle; what is moved is one partial sum for
    each bucket of a chunk, and those of a bucket across a chunk's edge are added up.
    """
    return throughput_rollup(chunk_values(chunks, chunk_size), size)


def format_series(buckets: DataFrame) -> DataFrame:
    """Text lines ``name 0 s1 s2 ...`` for export: a series is one line, so it must fit a row.

    Series of any length are kept and read as ``series_chunks``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "total")))
    values = F.transform(ordered, lambda b: b["total"].cast("string"))
    return buckets.groupBy("series").agg(F.array_join(values, " ").alias("_v")).select(
        F.concat_ws(" ", "series", "_v").alias("value")
    )
