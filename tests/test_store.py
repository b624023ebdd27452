"""Layouts keep every row, and stored tables are pruned."""

import pytest
from helpers import KINDS, build, rows
from pyspark.sql import functions as F

from geotrail.operators import candidates, models, partition, queries
from geotrail.plans import inputs as i
from geotrail.sources import store

COLUMNS = ["event_id", "traj_id", "x", "y", "t", "loc", "block"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(spark, sf_dir, path, layout, kind="quadtree", window=200_000):
    points = i.points(spark, sf_dir)
    model = build(kind, spark, points, capacity=100)
    keyed = partition.partition_points(points, model, window)
    store.write_store(keyed, model, window, path, layout, partitions=4)
    return keyed, store.read_store(spark, path)


@pytest.mark.parametrize("layout", store.LAYOUTS)
def test_roundtrip(layout, spark, sf_dir, new_dir):
    keyed, opened = written(spark, sf_dir, new_dir, layout)
    assert rows(opened.points.select(*COLUMNS)) == rows(keyed.select(*COLUMNS))
    assert dict(opened.points.dtypes)["block"] == "bigint"
    assert rows(opened.counts) == rows(partition.partition_counts(keyed))
    assert opened.fullest == opened.counts.agg(F.max("n_points")).first()[0]
    assert opened.longest == keyed.groupBy("traj_id").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("kind", KINDS)
def test_reopened_models_answer_and_assign(kind, spark, sf_dir, new_dir):
    keyed, opened = written(spark, sf_dir, new_dir, "clustered", kind)
    points = i.points(spark, sf_dir)
    again = partition.partition_points(points, opened.model, opened.window)
    assert rows(again.select("event_id", "loc", "block")) == rows(keyed.select("event_id", "loc", "block"))
    got = queries.circle_query(opened.points, opened.model, opened.window, i.CIRCLE, longest=opened.longest)
    assert got.count() == 14


def test_clustered_files_hold_ranges(spark, sf_dir, new_dir):
    _, opened = written(spark, sf_dir, new_dir, "clustered")
    files = opened.points.withColumn("file", F.input_file_name()).groupBy("file").agg(
        F.min(F.struct("loc", "block")).alias("lo"), F.max(F.struct("loc", "block")).alias("hi")
    )
    ranges = sorted((r["lo"], r["hi"]) for r in files.collect())
    assert len(ranges) == 4
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_one_partition_spreads_over_files(spark, sf_dir, new_dir):
    copies = i.points(spark, sf_dir).select(
        F.lit("same").alias("traj_id"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1).cast("bigint").alias("t")
    )
    model = build("grid", spark, copies)
    store.write_store(partition.partition_points(copies, model, 10), model, 10, new_dir, partitions=4)
    points = store.read_store(spark, new_dir).points
    sizes = [r["count"] for r in points.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 4 and max(sizes) < 500


def test_single_query_prunes_directories_and_pushes_ranges(spark, sf_dir, new_dir):
    _, opened = written(spark, sf_dir, new_dir, "dirs")
    plan = plan_of(queries.query_points(opened.points, opened.model, opened.window, i.CIRCLE))
    filters = plan[plan.index("PartitionFilters") :]
    assert "loc" in filters[:400] and "block" in filters[:400]
    pushed = plan[plan.index("PushedFilters") :]
    assert all(f"GreaterThanOrEqual({c}" in pushed for c in "xyt")
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_workload_prunes_directories_at_run_time(spark, sf_dir, new_dir):
    _, opened = written(spark, sf_dir, new_dir, "dirs")
    got = queries.workload_points(opened.points, i.circles(spark, sf_dir), opened.model, opened.window)
    plan = plan_of(got)
    assert "dynamicpruning" in plan
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_listed_partitions_only(spark, sf_dir, new_dir):
    keyed, opened = written(spark, sf_dir, new_dir, "dirs")
    some = keyed.select("loc", "block").distinct().limit(3)
    missing = spark.createDataFrame([("nowhere", 7)], "loc string, block bigint")
    got = store.read_partitions(opened, some.unionByName(missing))
    assert rows(got.select(*COLUMNS)) == rows(keyed.join(some, ["loc", "block"], "left_semi").select(*COLUMNS))
    assert store.read_partitions(opened, missing).count() == 0


def test_assignment_moves_no_points(spark, sf_dir):
    points = i.points(spark, sf_dir)
    for kind in KINDS:
        plan = plan_of(partition.partition_points(points, build(kind, spark, points), i.WINDOW))
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
        assert "NestedLoop" not in plan and "Python" not in plan


def test_many_partitions_are_not_broadcast_for_the_size_of_their_file(spark, new_dir):
    """Sorted counts are a small file and many rows, and a few queries meet few of them."""
    counts = spark.range(60_000).selectExpr("'g0_0' AS loc", "id AS block", "1L AS n_points")
    counts.coalesce(1).write.parquet(new_dir)
    model = models.build_grid(spark, i.BOUNDS, 2, 2)
    asked = spark.createDataFrame([(1, 5.0, 5.0, 1.0, 10, 25)], "query_id long, x double, y double, r double, ta long, tb long")
    got = candidates.existing_candidates(asked, model, 10, spark.read.parquet(new_dir)).select("query_id", "loc", "block")
    assert rows(got) == [(1, "g0_0", 1), (1, "g0_0", 2)]
    joins = [line for line in plan_of(got).split("Initial Plan")[0].splitlines() if "Join [loc" in line]
    assert joins and not any("BuildRight" in line for line in joins)
