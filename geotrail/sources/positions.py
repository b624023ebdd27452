"""Place of a row in its files, and what depends on it: skipping the first rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.operators.numbering import totals_before


def with_row_number(files: DataFrame) -> DataFrame:
    """Adds ``row_no``, from 0 in file order, to a DataFrame that reads files.

    Order: file path, then place in the file. Parquet readers say the place of a row in its
    file, so only the rows of each file are counted and added up. For other formats rows are
    counted for each split of the scan; a row's place is its place in the split after the
    splits before. Nothing but these counts is moved, and no row is written.
    """
    path = F.col("_metadata.file_path").alias("_file")
    try:
        placed = files.select("*", path, F.col("_metadata.row_index").alias("_at"))
        sizes = files.select(path).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    except AnalysisException:  # the format has no row index
        return _by_split(files, path)
    starts = totals_before(sizes, ["_file"], "_n").select("_file", "before")
    numbered = placed.join(F.broadcast(starts), "_file")
    return numbered.withColumn("row_no", F.col("before") + F.col("_at")).select(*files.columns, "row_no")


def _by_split(files: DataFrame, path) -> DataFrame:
    """Row numbers from the splits of the scan, which both readings plan alike."""
    placed = files.select("*", path, F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = placed.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    by_file = totals_before(splits, ["_start"], "_n", by=["_file"]).withColumnRenamed("before", "_in_file")
    sizes = splits.groupBy("_file").agg(F.sum("_n").alias("_n"))
    starts = by_file.join(totals_before(sizes, ["_file"], "_n").select("_file", "before"), "_file")
    starts = starts.select("_file", "_start", (F.col("before") + F.col("_in_file") - F.col("_first")).alias("_shift"))
    numbered = placed.join(F.broadcast(starts), ["_file", "_start"])
    return numbered.withColumn("row_no", F.col("_id") + F.col("_shift")).select(*files.columns, "row_no")


def skip_rows(files: DataFrame, n: int) -> DataFrame:
    """All rows but the first ``n`` in file order."""
    if n < 0:
        raise ValueError(f"cannot skip {n} rows")
    return with_row_number(files).where(F.col("row_no") >= n).drop("row_no")
