import pytest
from helpers import EDGE_POINTS, points_of, rows
from pyspark.sql import functions as F

from geotrail.functions.keys import index_key, order_index_keys, parse_index_key, time_block
from geotrail.operators import gather, metrics, partition
from geotrail.plans import inputs as i
from geotrail.sources import logs, points as source, positions, workload


def test_text_lines(spark, new_dir):
    lines = ["a;1.5 2.25 3;4 5.123456789 -6", "", "b;7 8 9;", "empty"]
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(new_dir)
    nested = source.read_trajectories(spark, new_dir, partitions=3)
    assert nested.rdd.getNumPartitions() == 3
    got = {r["traj_id"]: [tuple(p) for p in r["points"]] for r in nested.collect()}
    assert got == {"a": [(3, 1.5, 2.25), (-6, 4.0, 5.123456789)], "b": [(9, 7.0, 8.0)], "empty": []}
    rounded = source.read_trajectories(spark, new_dir, decimals=5).where("traj_id = 'a'").first()
    assert rounded["points"][1]["y"] == 5.12346


def test_long_and_nested_files(spark, tmp_path):
    points = points_of(spark, EDGE_POINTS)
    nested = gather.gather(points, ["traj_id"], ["t", "x", "y"]).select("traj_id", "points")
    for fmt in ("parquet", "json", "csv", "orc"):
        points.write.format(fmt).save(str(tmp_path / fmt))
        assert rows(source.read_points(spark, str(tmp_path / fmt), fmt)) == rows(points)
    for fmt in ("parquet", "json"):
        nested.write.format(fmt).save(str(tmp_path / ("nested" + fmt)))
        read = source.read_trajectories(spark, str(tmp_path / ("nested" + fmt)), fmt)
        assert rows(source.flatten_points(read)) == rows(points)


def test_replicas_are_separate_trajectories(spark):
    copies = source.replicate(points_of(spark, EDGE_POINTS), 2)
    assert copies.count() == 2 * len(EDGE_POINTS)
    assert {r[0] for r in copies.select("traj_id").distinct().collect()} >= {"rim#0", "rim#1"}


def test_row_numbers_follow_the_files(spark, new_dir):
    spark.range(0, 5000, 1, 7).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("value")).write.text(new_dir)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        files = spark.read.text(new_dir)
        assert files.rdd.getNumPartitions() > 20
        numbered = positions.with_row_number(files)
        for size in ("1000", "333", "100000"):  # other splits between the call and the answer
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert numbered.where("row_no = CAST(value AS BIGINT)").count() == 5000
        assert positions.skip_rows(files, 4990).count() == 10
        assert positions.skip_rows(files, 0).count() == 5000
        assert positions.skip_rows(files, 9999).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_workload_text(spark, sf_dir, tmp_path):
    circles = i.circles(spark, sf_dir)
    workload.write_workload(circles, str(tmp_path / "c"))
    back = workload.read_workload(spark, str(tmp_path / "c"))
    ordered = circles.orderBy("query_id").collect()
    got = back.orderBy("query_id").collect()
    assert [tuple(r[c] for c in ("x", "y", "r", "ta", "tb")) for r in got] == [
        tuple(r[c] for c in ("x", "y", "r", "ta", "tb")) for r in ordered
    ]
    assert [r["query_id"] for r in got] == list(range(1, len(ordered) + 1))
    workload.write_workload(i.boxes(spark, sf_dir), str(tmp_path / "b"))
    assert workload.read_workload(spark, str(tmp_path / "b"), workload.BOX_SCHEMA).count() == len(ordered)


def test_integer_workload_lines_and_bad_lines(spark, tmp_path):
    (tmp_path / "q.txt").write_text("200,210,5,1,1000\n10,20,3,7,9\n")
    got = workload.read_workload(spark, str(tmp_path / "q.txt"))
    assert rows(got.select("query_id", "x", "y", "r", "ta", "tb")) == [
        (1, 200.0, 210.0, 5.0, 1, 1000),
        (2, 10.0, 20.0, 3.0, 7, 9),
    ]
    (tmp_path / "bad.txt").write_text("200,here,5,1,1000\n")
    with pytest.raises(Exception):
        workload.read_workload(spark, str(tmp_path / "bad.txt")).collect()


def test_keys(spark):
    keyed = spark.createDataFrame([("q1", 10), ("q1", 9), ("q0", -1)], "loc string, block bigint")
    keys = keyed.select(index_key(F.col("loc"), F.col("block")).alias("key"))
    assert rows(keys) == [("1&q0&-1",), ("1&q1&10",), ("1&q1&9",)]
    assert rows(keys.select(*parse_index_key(F.col("key")))) == [("1", "q0", -1), ("1", "q1", 9), ("1", "q1", 10)]
    ordered = order_index_keys(keyed.withColumn("oid", F.lit("1"))).collect()
    assert [(r["loc"], r["block"]) for r in ordered] == [("q0", -1), ("q1", 10), ("q1", 9)]
    ranked = partition.rank_index_keys(keyed).orderBy("key_rank").collect()
    assert [(r["loc"], r["block"]) for r in ranked] == [("q0", -1), ("q1", 10), ("q1", 9)]
    with pytest.raises(Exception, match="null"):
        keyed.select(index_key(F.lit(None).cast("string"), F.col("block"))).collect()
    assert spark.range(1).select(time_block(F.lit(-5), 3)).first()[0] == -1


def test_counter_log(spark, tmp_path):
    (tmp_path / "run1.txt").write_text("Timer: 10\nCounter: 3\nTimer: 20\nCounter: 3\nTimer: 30\nCounter: 10\n")
    (tmp_path / "run2.txt").write_text("Timer: 10\nCounter: 5\n")
    samples = logs.read_counter_log(spark, str(tmp_path))
    for size in (1, 3, 1000):
        got = metrics.throughput(samples, size).orderBy("run", "seq").collect()
        assert [(r["run"], r["throughput"]) for r in got] == [("run1.txt", 3), ("run1.txt", 0), ("run1.txt", 7), ("run2.txt", 5)]


def test_series_rollup(spark):
    lines = spark.createDataFrame([("cold 9 1 2 3 4 5 6 7",), ("short 4",)], "value string")
    buckets = metrics.throughput_rollup(logs.parse_series(lines))
    assert rows(metrics.format_series(buckets)) == [("cold 0 21 7",), ("short 0",)]


def test_series_in_chunks(spark):
    values = [("long", k, 3 * k + 1) for k in range(1000) if k % 97] + [("one", 0, 5)]
    series = spark.createDataFrame(values, "series string, pos bigint, v bigint")
    for size in (1, 7, 64, 5000):
        chunks = metrics.series_chunks(series, size)
        assert chunks.where(F.size("items") > size).count() == 0
        assert rows(metrics.chunk_values(chunks, size)) == sorted(values)
        assert rows(metrics.rollup_chunks(chunks, 6, size)) == rows(metrics.throughput_rollup(series, 6))


def test_partitions_and_locations(spark, sf_dir, tmp_path):
    points = i.points(spark, sf_dir)
    assert source.set_partitions(points, 5).rdd.getNumPartitions() == 5
    ranged = source.set_partitions(points, 5, "t").groupBy(F.spark_partition_id().alias("p")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spans = sorted((r["a"], r["b"]) for r in ranged.collect())
    assert len(spans) == 5 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    points.select("traj_id", "x", "y", "t").write.parquet(f"file://{tmp_path}/uri")
    for path in (f"file://{tmp_path}/uri", f"{tmp_path}/uri"):
        assert rows(source.read_points(spark, path)) == rows(points.select("traj_id", "x", "y", "t"))
