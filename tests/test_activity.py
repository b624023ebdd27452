from helpers import build, rows
from pyspark.sql import functions as F

from geotrail.operators import activity, metrics, partition
from geotrail.plans import inputs as i
from geotrail.streaming import read_stream, run_available
from geotrail.streaming.activity import activity_stream
from geotrail.streaming.throughput import throughput_stream

LOG = "loc string, block bigint, access_ms bigint"


def log_of(spark, *times):
    return spark.createDataFrame([("a", 1, t) for t in times], LOG)


def test_an_access_exactly_one_window_later_starts_a_new_period(spark):
    log = log_of(spark, 0, 60_000, 119_999, 300_000)
    got = activity.activity_sessions(log, 60_000).select("from_ms", "cold_ms", "n_accesses")
    assert rows(got) == [(0, 60_000, 1), (60_000, 179_999, 2), (300_000, 360_000, 1)]


def test_cold_from_the_moment_the_window_is_over(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 2)], "loc string, block bigint")
    seen = activity.last_access(log_of(spark, 100, 500, 9000), until_ms=600)
    for now, hot in ((609, {"a"}), (610, set()), (119, {"a", "b"}), (120, {"a"})):
        status = activity.classify_partitions(keys, seen, now, window_ms=100, delay_ms=10, loaded_ms=10)
        assert {r["loc"] for r in status.where("is_hot").collect()} == hot


def test_eviction_keeps_keys_and_overlay_brings_contents_back(spark, sf_dir):
    points = i.points(spark, sf_dir)
    keyed = partition.partition_points(points, build("grid", spark, points), 500_000).select("event_id", "traj_id", "x", "y", "t", "loc", "block")
    keys = partition.partition_keys(keyed)
    log = keys.where("block >= 2").withColumn("access_ms", F.lit(1000))
    status = activity.classify_partitions(keys, activity.last_access(log), 1050, window_ms=100)
    left = activity.evict_cold(keyed, status)
    assert left.select("loc", "block").distinct().count() == keys.count()
    held = left.select(F.sum(F.size("points"))).first()[0]
    assert held == keyed.where("block >= 2").count()
    assert left.where("NOT is_hot AND size(points) > 0").count() == 0
    assert activity.hot_count(status).first()["n_hot"] == keys.where("block >= 2").count()
    cold = activity.cold_requested(status, keys)
    assert rows(cold) == rows(keys.where("block < 2"))
    stale = keyed.withColumn("x", F.lit(-1.0))
    reloaded = keyed.join(cold, ["loc", "block"], "left_semi")
    merged = activity.overlay_partitions(stale, reloaded)
    assert merged.count() == keyed.count()
    assert merged.where("x = -1").count() == keyed.where("block >= 2").count()
    foreign = reloaded.withColumn("loc", F.lit("elsewhere"))
    assert rows(activity.overlay_partitions(keyed, foreign)) == rows(keyed)


def test_all_cold_has_null_contents(spark):
    emptied = activity.all_cold(spark.createDataFrame([("a", 1)], "loc string, block bigint")).first()
    assert emptied["points"] is None and emptied["is_hot"] is False


def test_counter_shows_empty_ticks(spark):
    done = spark.createDataFrame([(5,), (7,), (9500,), (2 * 86_400_000 + 1,)], "finished_ms bigint")
    got = rows(metrics.query_counter(done, 1000))
    assert got[:2] == [(1000, 2, 2), (2000, 0, 2)]
    assert got[9] == (10_000, 1, 3) and got[-1] == (2 * 86_400_000 + 1000, 1, 4)
    assert len(got) == 2 * 86_400 + 1
    assert metrics.query_counter(done.where("false"), 1000).count() == 0


def event_stream(spark, sf_dir):
    return read_stream(spark, sf_dir, i.events(spark, sf_dir).schema, glob="events.parquet")


def test_stream_equals_batch_activity(spark, sf_dir):
    points = i.points(spark, sf_dir)
    grid = build("grid", spark, points)
    seen = F.timestamp_micros(i.finished_us(F.col("ts"))).alias("access_ts")

    def accesses(events):
        return partition.partition_points(i.st_points(events, seen), grid, i.WINDOW).select("loc", "block", "access_ts")

    period = ["loc", "block", "from_ms", "cold_ms", "n_accesses"]
    streamed = run_available(activity_stream(accesses(event_stream(spark, sf_dir)), i.STREAM_MS, "1 hour"), "periods")
    streamed = streamed.select("loc", "block", F.unix_millis("from_ts").alias("from_ms"), F.unix_millis("cold_ts").alias("cold_ms"), "n_accesses")
    batch = accesses(i.events(spark, sf_dir)).withColumn("access_ms", F.unix_millis("access_ts"))
    last = batch.agg(F.max("access_ms")).first()[0] - 3_600_000
    closed = activity.activity_sessions(batch, i.STREAM_MS).where(F.col("cold_ms") <= last)
    assert rows(streamed.select(*period)) == rows(closed.select(*period))
    assert 0 < streamed.count() < 1000


def test_stream_equals_batch_throughput(spark, sf_dir):
    done = event_stream(spark, sf_dir).select(F.timestamp_micros(i.finished_us(F.col("ts"))).alias("finished_ts"))
    streamed = run_available(throughput_stream(done, "10 seconds", "1 hour"), "ticks")
    finished = i.finished(spark, sf_dir)
    last = finished.agg(F.max("finished_ms")).first()[0] - 3_600_000
    batch = metrics.query_counter(finished, 10_000).where(f"finished > 0 AND tick_ms <= {last}")
    assert rows(streamed.select(F.unix_millis("tick_end"), "finished")) == rows(batch.select("tick_ms", "finished"))


def test_session_gap_tie_in_the_stream(spark, new_dir):
    log_of(spark, 0, 60_000, 119_999, 10_000_000).select(
        "loc", "block", F.timestamp_millis("access_ms").alias("access_ts")
    ).write.parquet(new_dir)
    stream = read_stream(spark, new_dir, "loc string, block bigint, access_ts timestamp")
    got = run_available(activity_stream(stream, 60_000, "1 second"), "ties")
    spans = rows(got.select(F.unix_millis("from_ts"), F.unix_millis("cold_ts"), "n_accesses"))
    assert spans == [(0, 60_000, 1), (60_000, 179_999, 2)]
