"""Continuous throughput and continuous partition activity."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geotrail.scratch import scratch_dir


def read_stream(spark, path: str, schema, glob: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A stream of the files of a folder, those present and those that arrive."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and return what it emitted, as a table.

    Append mode with a fresh checkpoint and a fresh output folder, both shared: the
    query restarts from them after a loss, and files are committed exactly once.
    """
    spark = stream.sparkSession
    out = scratch_dir(spark, name)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .option("path", f"{out}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
