"""Small tables and stream files in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
"""Largest table, in rows of a few short columns, that a join is told to broadcast."""


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Without that setting only a session in one process gets a folder of its own; on a
    cluster, a local one included, a machine-local folder would be lost with its machine,
    so the setting is demanded.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="geotrail-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def publish(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back.

    Cuts the lineage, survives lost executors, and gives Spark the true size of the
    table, which is what its own choice of a broadcast join goes by.
    """
    return publish_with_facts(df, name, F.count(F.lit(1)).alias("rows"))[0]


def publish_with_facts(df: DataFrame, name: str, *facts: Column) -> tuple[DataFrame, dict]:
    """Like ``publish``, with aggregates of the rows that are taken while they are written."""
    path, seen = scratch_dir(df.sparkSession, name), Observation()
    df.observe(seen, *facts).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs run inside, put back after them."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
