"""One query for each operator, over the whole of the given tables.

Results are flat and every column is named, so that they compare with plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.keys import index_key, parse_index_key, time_block
from geotrail.functions.predicates import in_box, in_circle, in_time
from geotrail.operators import activity, assign, candidates, gather, metrics, models, partition, queries, sample
from geotrail.operators.numbering import number_within
from geotrail.params import Bounds
from geotrail.plans import inputs as i
from geotrail.scratch import scratch_dir
from geotrail.sources import logs, positions, store, workload
from geotrail.sources import points as source
from geotrail.streaming import read_stream, run_available
from geotrail.streaming.activity import activity_stream
from geotrail.streaming.throughput import throughput_stream

CHECKS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
POINT = ["traj_id", "x", "y", "t"]
BOX = ["x0", "y0", "x1", "y1"]
KEYS = ["loc", "block"]


def check(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    CHECKS[fn.__name__] = fn
    return fn


def quadtree(spark: SparkSession, d: str) -> models.SpatialModel:
    return models.build_quadtree(i.points(spark, d), i.BOUNDS, i.CAPACITY, i.MAX_DEPTH)


def keyed_points(spark: SparkSession, d: str) -> tuple[models.SpatialModel, DataFrame]:
    model = quadtree(spark, d)
    return model, partition.partition_points(i.points(spark, d), model, i.WINDOW)


def workload_partitions(spark: SparkSession, d: str, model: models.SpatialModel) -> DataFrame:
    return candidates.candidate_partitions(i.circles(spark, d), model, i.WINDOW)


def held_partitions(spark: SparkSession, d: str, model: models.SpatialModel, keyed: DataFrame) -> DataFrame:
    """Candidates of the workload that hold points."""
    return candidates.existing_candidates(i.circles(spark, d), model, i.WINDOW, partition.partition_counts(keyed))


def flat(nested: DataFrame) -> DataFrame:
    return gather.summarize(nested, ["query_id", "traj_id"])


# ---- sources, sinks, layout --------------------------------------------------------


@check
def read_trajectories(spark, d):
    nested = gather.gather(i.points(spark, d), ["traj_id"], ["t", "x", "y"])
    path = scratch_dir(spark, "trajectories")
    source.format_trajectories(nested).write.text(path)
    return source.flatten_points(source.read_trajectories(spark, path))


@check
def read_points(spark, d):
    """Points at a location of one's choice, here in the shared folder as JSON."""
    path = scratch_dir(spark, "points")
    i.points(spark, d).select(*POINT).write.json(path)
    return source.read_points(spark, path, "json")


@check
def set_partitions(spark, d):
    """Rows of each Spark partition, counted: as many partitions as were asked for."""
    dealt = source.set_partitions(i.points(spark, d), i.PARTITIONS).groupBy(F.spark_partition_id().alias("part")).count()
    return dealt.agg(F.count("*").alias("n_partitions"), F.sum("count").alias("n_points"))


@check
def replicate_dataset(spark, d):
    return source.replicate(i.points(spark, d), 3).select(*POINT)


@check
def store_roundtrip(spark, d):
    model, keyed = keyed_points(spark, d)
    path = scratch_dir(spark, "store")
    store.write_store(keyed, model, i.WINDOW, path)
    return store.read_store(spark, path).points.select("event_id", *POINT, *KEYS)


@check
def read_partitions(spark, d):
    model, keyed = keyed_points(spark, d)
    path = scratch_dir(spark, "store")
    store.write_store(keyed, model, i.WINDOW, path)
    opened = store.read_store(spark, path)
    wanted = candidates.existing_candidates(i.circles(spark, d), opened.model, i.WINDOW, opened.counts)
    return store.read_partitions(opened, wanted).select("event_id", *KEYS)


@check
def read_workload(spark, d):
    path = scratch_dir(spark, "workload")
    workload.write_workload(i.every_circle(spark, d), path)
    return workload.read_workload(spark, path)


@check
def format_workload(spark, d):
    return workload.format_workload(i.every_circle(spark, d))


@check
def skip_rows(spark, d):
    return positions.skip_rows(i.events(spark, d), 899).select("event_id", "user_id", "event_type")


# ---- projections, filters, predicates ----------------------------------------------


@check
def flatten_points(spark, d):
    return source.flatten_points(gather.gather(i.points(spark, d), ["traj_id"], ["t", "x", "y"]))


@check
def time_block_(spark, d):
    t = F.col("t")
    return i.points(spark, d).select(
        "event_id",
        time_block(t, i.WINDOW).alias("block"),
        time_block(t - 1_000_000, i.WINDOW).alias("block_shifted"),
    )


@check
def index_key_(spark, d):
    _, keyed = keyed_points(spark, d)
    return keyed.select("event_id", index_key(F.col("loc"), F.col("block")).alias("key"))


@check
def parse_index_key_(spark, d):
    keys = index_key_(spark, d)
    return keys.select("event_id", *parse_index_key(F.col("key")))


@check
def index_order(spark, d):
    _, keyed = keyed_points(spark, d)
    return partition.rank_index_keys(partition.partition_keys(keyed))


@check
def filter_circle(spark, d):
    q = i.CIRCLE
    return i.points(spark, d).where(in_circle("x", "y", q.x, q.y, q.r)).select("event_id", *POINT)


@check
def filter_box(spark, d):
    q = i.BOX
    return i.points(spark, d).where(in_box("x", "y", q.x0, q.y0, q.x1, q.y1)).select("event_id", *POINT)


@check
def filter_time(spark, d):
    return i.points(spark, d).where(in_time("t", i.CIRCLE.ta, i.CIRCLE.tb)).select("event_id", *POINT)


@check
def number_queries(spark, d):
    return queries.number_queries(i.every_circle(spark, d)).select("query_id", "issued_ms", "query_no")


@check
def outside_points(spark, d):
    half = Bounds(0.0, 0.0, 512.0, 512.0)
    model = models.build_quadtree(i.points(spark, d), half, i.CAPACITY, i.MAX_DEPTH)
    assigned = assign.assign_regions(i.points(spark, d), model)
    return assigned.select("event_id", (F.col("loc") == "outside").alias("is_outside"))


# ---- models ------------------------------------------------------------------------


@check
def sample_trajectories(spark, d):
    return sample.sample_trajectories(i.points(spark, d), i.SAMPLE, i.SEED).select("event_id", "traj_id", "x", "y")


@check
def grid_model(spark, d):
    model = models.build_grid(spark, i.BOUNDS, *i.GRID)
    held = assign.assign_regions(i.points(spark, d), model).groupBy("loc").agg(F.count("*").alias("n_points"))
    return model.regions.join(held, "loc", "left").select("loc", *BOX, F.coalesce("n_points", F.lit(0)).alias("n_points"))


@check
def grid_assign(spark, d):
    model = models.build_grid(spark, i.BOUNDS, *i.GRID)
    return assign.assign_regions(i.points(spark, d), model).select("event_id", "loc")


@check
def quadtree_model(spark, d):
    return quadtree(spark, d).regions.select("loc", F.col("level").cast("bigint").alias("level"), "ix", "iy", *BOX)


@check
def quadtree_any_depth(spark, d):
    """A quadtree whose depth the data decide: the points of each region."""
    points = i.points(spark, d)
    model = models.build_quadtree(points, i.BOUNDS, i.SMALL_CAPACITY)
    return assign.assign_regions(points, model).groupBy("loc").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@check
def quadtree_assign(spark, d):
    return assign.assign_regions(i.points(spark, d), quadtree(spark, d)).select("event_id", "loc")


def kdtree(spark, d):
    return models.build_kdtree(i.points(spark, d), i.BOUNDS, i.CAPACITY)


@check
def kdtree_model(spark, d):
    return kdtree(spark, d).regions.select("loc", *BOX)


@check
def kdtree_assign(spark, d):
    return assign.assign_regions(i.points(spark, d), kdtree(spark, d)).select("event_id", "loc")


def strtree(spark, d):
    return models.build_strtree(i.points(spark, d), i.BOUNDS, i.CAPACITY)


@check
def strtree_model(spark, d):
    """Open edges are shown as null."""
    edges = [F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) for c in BOX]
    return strtree(spark, d).regions.select("loc", *edges)


@check
def strtree_assign(spark, d):
    return assign.assign_regions(i.points(spark, d), strtree(spark, d)).select("event_id", "loc")


@check
def strtree_boxes(spark, d):
    return models.tight_boxes(assign.assign_regions(i.points(spark, d), strtree(spark, d)))


@check
def regions_for_circle(spark, d):
    q = i.CIRCLE
    return models.regions_for_circle(quadtree(spark, d), q.x, q.y, q.r).select("loc")


@check
def regions_for_box(spark, d):
    q = i.BOX
    return models.regions_for_box(quadtree(spark, d), q.x0, q.y0, q.x1, q.y1).select("loc")


@check
def model_size(spark, d):
    sizes = [
        models.model_size(build(spark, d)).withColumn("kind", F.lit(build.__name__))
        for build in (quadtree, kdtree, strtree)
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


# ---- partitioning and aggregations -------------------------------------------------


@check
def partition_points(spark, d):
    return keyed_points(spark, d)[1].select("event_id", *KEYS)


@check
def gather_partitions(spark, d):
    return gather.summarize(gather.gather_partitions(keyed_points(spark, d)[1]), KEYS)


@check
def gather_slices(spark, d):
    """Partitions in slices of three points."""
    nested = gather.gather_partitions(keyed_points(spark, d)[1], max_points=3)
    point = lambda p: F.concat_ws(" ", p["t"].cast("string"), p["traj_id"])
    return nested.select(*KEYS, "part", F.array_join(F.transform("points", point), ",").alias("points"))


@check
def partition_counts(spark, d):
    return partition.partition_counts(keyed_points(spark, d)[1])


@check
def partition_profile(spark, d):
    return partition.partition_profile(keyed_points(spark, d)[1])


@check
def build_trajectories(spark, d):
    nested = gather.build_trajectories(queries.scan_points(i.points(spark, d), i.CIRCLE))
    times = F.array_join(F.transform("points", lambda p: p["t"].cast("string")), ",")
    return nested.select("query_id", "traj_id", F.size("points").cast("bigint").alias("n_points"), times.alias("times"))


@check
def query_result_counts(spark, d):
    model, keyed = keyed_points(spark, d)
    asked = i.far_circles(spark, d)
    return queries.query_result_counts(asked, queries.workload_points(keyed, asked, model, i.WINDOW, marked=True))


# ---- range queries -----------------------------------------------------------------


@check
def blocks_for_interval(spark, d):
    blocks = candidates.blocks_for_interval(F.col("ta"), F.col("tb"), i.WINDOW)
    return i.every_circle(spark, d).select("query_id", F.explode(blocks).alias("block"))


@check
def block_ranges(spark, d):
    """Runs of blocks, of bounded and of open intervals."""
    run = candidates.block_range(F.col("ta"), F.col("tb"), i.WINDOW)
    bounded, opened = i.every_circle(spark, d), i.open_circles(spark, d)
    return bounded.select("query_id", run.alias("run")).unionByName(opened.select((-F.col("query_id") - 1).alias("query_id"), run.alias("run"))).select("query_id", "run.*")


@check
def candidate_ranges(spark, d):
    runs = candidates.candidate_ranges(i.circles(spark, d), quadtree(spark, d), i.WINDOW)
    return runs.select("query_id", "loc", "first_block", "last_block")


@check
def candidates_open_interval(spark, d):
    """The partitions that circles without ends in time can have hits in."""
    model, keyed = keyed_points(spark, d)
    held = candidates.existing_candidates(i.open_circles(spark, d), model, i.WINDOW, partition.partition_counts(keyed))
    return held.select("query_id", *KEYS)


@check
def last_access_open_interval(spark, d):
    """Accesses of circles without ends in time, to the partitions that there are."""
    model, keyed = keyed_points(spark, d)
    held = candidates.existing_candidates(i.open_circles(spark, d), model, i.WINDOW, partition.partition_counts(keyed))
    return activity.last_access(activity.access_log(held))


@check
def candidate_partitions(spark, d):
    return workload_partitions(spark, d, quadtree(spark, d)).select("query_id", *KEYS)


@check
def fetch_partitions(spark, d):
    model, keyed = keyed_points(spark, d)
    return candidates.fetch_partitions(keyed, held_partitions(spark, d, model, keyed)).select("event_id", *KEYS)


@check
def circle_points(spark, d):
    model, keyed = keyed_points(spark, d)
    return queries.query_points(keyed, model, i.WINDOW, i.CIRCLE).select("query_id", "event_id", *POINT)


@check
def circle_query(spark, d):
    model, keyed = keyed_points(spark, d)
    return flat(queries.circle_query(keyed, model, i.WINDOW, i.CIRCLE))


@check
def circle_query_points(spark, d):
    """Every point of the nested answer, in its place."""
    model, keyed = keyed_points(spark, d)
    nested = queries.circle_query(keyed, model, i.WINDOW, i.CIRCLE)
    return nested.select("query_id", "traj_id", "part", F.posexplode("points").alias("pos", "p")).select(
        "query_id", "traj_id", "part", F.col("pos").cast("bigint").alias("pos"), "p.t", "p.x", "p.y"
    )


def circle_query_on(spark, d, model):
    keyed = partition.partition_points(i.points(spark, d), model, i.WINDOW)
    return flat(queries.circle_query(keyed, model, i.WINDOW, i.CIRCLE))


@check
def circle_query_kdtree(spark, d):
    return circle_query_on(spark, d, kdtree(spark, d))


@check
def circle_query_strtree(spark, d):
    return circle_query_on(spark, d, strtree(spark, d))


@check
def box_query(spark, d):
    model, keyed = keyed_points(spark, d)
    return flat(queries.box_query(keyed, model, i.WINDOW, i.BOX))


@check
def circle_workload(spark, d):
    model, keyed = keyed_points(spark, d)
    return flat(queries.circle_workload(keyed, i.circles(spark, d), model, i.WINDOW))


@check
def box_workload(spark, d):
    model, keyed = keyed_points(spark, d)
    return flat(queries.box_workload(keyed, i.boxes(spark, d), model, i.WINDOW))


def workload_on(spark, d, model, run, asked):
    keyed = partition.partition_points(i.points(spark, d), model, i.WINDOW)
    return flat(run(keyed, asked, model, i.WINDOW))


@check
def circle_workload_kdtree(spark, d):
    return workload_on(spark, d, kdtree(spark, d), queries.circle_workload, i.circles(spark, d))


@check
def circle_workload_strtree(spark, d):
    return workload_on(spark, d, strtree(spark, d), queries.circle_workload, i.circles(spark, d))


@check
def box_workload_kdtree(spark, d):
    return workload_on(spark, d, kdtree(spark, d), queries.box_workload, i.boxes(spark, d))


@check
def box_workload_grid(spark, d):
    return workload_on(spark, d, models.build_grid(spark, i.BOUNDS, *i.GRID), queries.box_workload, i.boxes(spark, d))


@check
def hot_workload(spark, d):
    """Every circle moved to one place and one interval: few partitions do all the work."""
    model, keyed = keyed_points(spark, d)
    hits = queries.workload_points(keyed, i.hot_circles(spark, d), model, i.WINDOW, work=1 << 16)
    return hits.groupBy("query_id").agg(F.count("*").alias("n_points"), F.sum("event_id").alias("id_sum"))


@check
def workload_open_interval(spark, d):
    """Circles whose intervals are as long as numbers go."""
    model, keyed = keyed_points(spark, d)
    return flat(queries.circle_workload(keyed, i.open_circles(spark, d), model, i.WINDOW))


@check
def circle_scan(spark, d):
    return queries.scan_points(i.points(spark, d), i.CIRCLE).select("query_id", "event_id", *POINT)


@check
def box_scan(spark, d):
    return queries.scan_points(i.points(spark, d), i.BOX).select("query_id", "event_id", *POINT)


# ---- partition activity ------------------------------------------------------------


def accesses(spark, d, model):
    return activity.access_log(workload_partitions(spark, d, model))


def status_now(spark, d, model, keyed):
    seen = activity.last_access(accesses(spark, d, model), i.NOW_MS)
    return activity.classify_partitions(partition.partition_keys(keyed), seen, i.NOW_MS, i.ACTIVE_MS, i.DELAY_MS)


@check
def overlay_partitions(spark, d):
    model, keyed = keyed_points(spark, d)
    current = keyed.select("event_id", *KEYS, F.lit("kept").alias("origin"))
    wanted = held_partitions(spark, d, model, keyed)
    reloaded = candidates.fetch_partitions(current, wanted).withColumn("origin", F.lit("reloaded"))
    return activity.overlay_partitions(current, reloaded)


@check
def cold_requested(spark, d):
    model, keyed = keyed_points(spark, d)
    return activity.cold_requested(status_now(spark, d, model, keyed), workload_partitions(spark, d, model))


@check
def last_access(spark, d):
    return activity.last_access(accesses(spark, d, quadtree(spark, d)))


@check
def classify_partitions(spark, d):
    return status_now(spark, d, *keyed_points(spark, d))


@check
def evict_cold(spark, d):
    model, keyed = keyed_points(spark, d)
    left = activity.evict_cold(keyed, status_now(spark, d, model, keyed))
    return left.groupBy(*KEYS, "is_hot").agg(F.sum(F.size("points")).alias("n_points"))


@check
def all_cold(spark, d):
    _, keyed = keyed_points(spark, d)
    emptied = activity.all_cold(partition.partition_keys(keyed))
    return emptied.select(*KEYS, "is_hot", F.col("points").isNotNull().alias("has_points"))


@check
def hot_count(spark, d):
    return activity.hot_count(status_now(spark, d, *keyed_points(spark, d)))


@check
def activity_sessions(spark, d):
    return activity.activity_sessions(accesses(spark, d, quadtree(spark, d)), i.SESSION_MS)


# ---- throughput --------------------------------------------------------------------


@check
def query_counter(spark, d):
    return metrics.query_counter(i.finished(spark, d), i.TICK_MS)


@check
def throughput(spark, d):
    samples = query_counter(spark, d).select(
        F.lit("events").alias("run"), F.expr(f"tick_ms div {i.TICK_MS}").alias("seq"), "counter"
    )
    return metrics.throughput(samples, 8640)


def hourly(spark, d):
    """Events of each type by hour, as a series of values."""
    hours = i.events(spark, d).groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("v"))
    return number_within(hours, ["series"], F.date_trunc("day", "hour"), ["hour"], "pos").select("series", "pos", "v")


@check
def series_chunks(spark, d):
    chunks = metrics.series_chunks(hourly(spark, d), i.CHUNK)
    return chunks.select("series", "chunk", F.array_join(F.transform("items", lambda v: v.cast("string")), " ").alias("items"))


@check
def throughput_rollup(spark, d):
    return metrics.rollup_chunks(metrics.series_chunks(hourly(spark, d), i.CHUNK), chunk_size=i.CHUNK)


@check
def parse_series(spark, d):
    return logs.parse_series(metrics.format_series(throughput_rollup(spark, d)))


@check
def format_series(spark, d):
    return metrics.format_series(throughput_rollup(spark, d))


def event_stream(spark, d):
    return read_stream(spark, d, i.events(spark, d).schema, glob="events.parquet")


@check
def stream_throughput(spark, d):
    done = event_stream(spark, d).select(F.timestamp_micros(i.finished_us(F.col("ts"))).alias("finished_ts"))
    ticks = run_available(throughput_stream(done, "10 seconds", "1 hour"), "ticks")
    return ticks.select(
        F.unix_millis("tick_start").alias("start_ms"), F.unix_millis("tick_end").alias("end_ms"), "finished"
    )


@check
def stream_activity(spark, d):
    grid = models.build_grid(spark, i.BOUNDS, *i.GRID)
    seen = F.timestamp_micros(i.finished_us(F.col("ts"))).alias("access_ts")
    keyed = partition.partition_points(i.st_points(event_stream(spark, d), seen), grid, i.WINDOW)
    periods = run_available(activity_stream(keyed.select(*KEYS, "access_ts"), i.STREAM_MS, "1 hour"), "periods")
    return periods.select(
        *KEYS, F.unix_micros("from_ts").alias("from_us"), F.unix_micros("cold_ts").alias("cold_us"), "n_accesses"
    )


for _name in ("time_block_", "index_key_", "parse_index_key_"):
    CHECKS[_name.rstrip("_")] = CHECKS.pop(_name)
