"""Text logs of a query run: counter samples and throughput series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.params import require_text
from geotrail.sources.positions import with_row_number


def read_counter_log(spark: SparkSession, path: str) -> DataFrame:
    """Counter samples ``run, seq, counter``; the run is the file.

    Lines are ``Timer: <ms>`` and ``Counter: <n>``; ``seq`` keeps the order of lines.
    """
    require_text(path=path)
    lines = spark.read.text(path).withColumn("run", F.col("_metadata.file_name"))
    return (
        with_row_number(lines)
        .where(F.col("value").startswith("Counter:"))
        .select("run", F.col("row_no").alias("seq"), F.split("value", r"\s+")[1].cast("bigint").alias("counter"))
    )


def parse_series(lines: DataFrame) -> DataFrame:
    """Values of throughput lines ``name v0 v1 ...``: ``series, pos, v``, pos from 0."""
    words = F.split(F.trim("value"), r"\s+")
    return (
        lines.where(F.trim("value") != "")
        .select(words[0].alias("series"), F.posexplode(F.slice(words, 2, F.size(words))).alias("pos", "v"))
        .withColumn("v", F.col("v").cast("bigint"))
    )
