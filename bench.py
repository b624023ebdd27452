"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``. A store is
written once; the queries run against it, as a user would run them, each pruned one
beside the full scan. Every time is the best of ``BENCH_RUNS`` (default 2) full runs.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from geotrail.operators import activity, candidates, metrics, models, partition, queries
from geotrail.plans import inputs as i
from geotrail.scratch import scratch_dir
from geotrail.sources import store


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("geotrail-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df: DataFrame) -> None:
    """Run the whole plan and all columns, without collecting anything."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count())))
    seconds: dict[str, float] = {}

    def timed(name: str, run):
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            result = run()
            if isinstance(result, DataFrame):
                consume(result)
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        return result

    points = i.points(spark, sf_dir)
    circles, boxes = i.circles(spark, sf_dir), i.boxes(spark, sf_dir)
    model = timed("build_quadtree", lambda: models.build_quadtree(points, i.BOUNDS, i.CAPACITY, i.MAX_DEPTH))
    timed("build_kdtree", lambda: models.build_kdtree(points, i.BOUNDS, i.CAPACITY))
    timed("build_strtree", lambda: models.build_strtree(points, i.BOUNDS, i.CAPACITY))
    timed("partition_points", lambda: partition.partition_points(points, model, i.WINDOW))
    keyed = partition.partition_points(points, model, i.WINDOW)

    def write() -> str:
        path = scratch_dir(spark, "bench-store")
        store.write_store(keyed, model, i.WINDOW, path)
        return path

    opened = store.read_store(spark, timed("write_store", write))
    p, m, w, n = opened.points, opened.model, opened.window, opened.longest
    timed("circle_query", lambda: queries.circle_query(p, m, w, i.CIRCLE, longest=n))
    timed("circle_scan", lambda: queries.build_trajectories(queries.scan_points(points, i.CIRCLE), longest=n))
    timed("box_query", lambda: queries.box_query(p, m, w, i.BOX, longest=n))
    timed("box_scan", lambda: queries.build_trajectories(queries.scan_points(points, i.BOX), longest=n))
    timed("candidate_partitions", lambda: candidates.candidate_partitions(circles, m, w))
    timed("circle_workload", lambda: queries.circle_workload(p, circles, m, w, longest=n))
    timed("box_workload", lambda: queries.box_workload(p, boxes, m, w, longest=n))
    timed("query_counts", lambda: queries.query_result_counts(circles, queries.workload_points(p, circles, m, w)))
    log = activity.access_log(candidates.candidate_partitions(circles, m, w))
    timed("last_access", lambda: activity.last_access(log))
    timed("activity_sessions", lambda: activity.activity_sessions(log, i.SESSION_MS))
    timed("query_counter", lambda: metrics.query_counter(i.finished(spark, sf_dir), i.TICK_MS))

    n_queries = circles.count()
    print(
        json.dumps(
            {
                "metric": "geotrail headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "workload_queries_per_10s": round(10 * n_queries / seconds["circle_workload"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
