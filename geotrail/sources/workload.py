"""Query workloads as CSV lines ``x,y,r,ta,tb`` (circles) or ``x0,y0,x1,y1,ta,tb``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.operators.candidates import shape_columns
from geotrail.params import require_text
from geotrail.sources.positions import with_row_number

CIRCLE_SCHEMA = "x double, y double, r double, ta bigint, tb bigint"
BOX_SCHEMA = "x0 double, y0 double, x1 double, y1 double, ta bigint, tb bigint"


def read_workload(spark: SparkSession, path: str, schema: str = CIRCLE_SCHEMA) -> DataFrame:
    """Workload with ``query_id`` 1, 2, ... in the order of the lines."""
    require_text(path=path)
    rows = with_row_number(spark.read.schema(schema).option("mode", "FAILFAST").csv(path))
    return rows.withColumn("query_id", F.col("row_no") + 1).drop("row_no")


def format_workload(workload: DataFrame) -> DataFrame:
    """One text column ``line`` for each query, beside its ``query_id``."""
    fields = [F.col(c).cast("string") for c in [*shape_columns(workload), "ta", "tb"]]
    return workload.select("query_id", F.concat_ws(",", *fields).alias("line"))


def write_workload(workload: DataFrame, path: str) -> None:
    """Lines in the order of ``query_id``, across the files of the folder too."""
    require_text(path=path)
    format_workload(workload).orderBy("query_id").select("line").write.text(path)
