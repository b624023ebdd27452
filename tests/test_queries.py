"""Pruned answers equal the answers of a full scan, for every model and every edge."""

import pytest
from helpers import EDGE_POINTS, KINDS, build, points_of, rows
from pyspark.sql import functions as F

from geotrail import BoxQuery, CircleQuery
from geotrail.operators import candidates, dealing, gather, models, partition, queries, regroup
from geotrail.plans import inputs as i

HIT = ["query_id", "traj_id", "t", "x", "y"]


def scan_workload(points, workload):
    """Brute force: every query against every point."""
    q = workload.select("query_id", *(F.col(c).alias("q" + c) for c in workload.columns if c not in ("query_id", "issued_ms")))
    if "r" in workload.columns:
        inside = "qr >= 0 AND (x - qx) * (x - qx) + (y - qy) * (y - qy) <= qr * qr"
    else:
        inside = "x BETWEEN qx0 AND qx1 AND y BETWEEN qy0 AND qy1"
    return points.join(q, F.expr(f"t BETWEEN qta AND qtb AND {inside}")).select(*HIT)


@pytest.mark.parametrize("kind", KINDS)
def test_single_queries(kind, spark, sf_dir):
    points = i.points(spark, sf_dir)
    model = build(kind, spark, points, capacity=20)
    keyed = partition.partition_points(points, model, i.WINDOW)
    for q in (i.CIRCLE, i.BOX):
        got = rows(queries.query_points(keyed, model, i.WINDOW, q).select(*HIT))
        assert got == rows(queries.scan_points(points, q).select(*HIT)) and got


@pytest.mark.parametrize("kind", KINDS)
def test_workloads(kind, spark, sf_dir):
    points = i.points(spark, sf_dir).unionByName(
        points_of(spark, EDGE_POINTS).withColumn("event_id", F.lit(-1).cast("bigint"))
    )
    model = build(kind, spark, points, capacity=20)
    keyed = partition.partition_points(points, model, i.WINDOW)
    for workload in (i.circles(spark, sf_dir), i.boxes(spark, sf_dir)):
        got = rows(queries.workload_points(keyed, workload, model, i.WINDOW).select(*HIT))
        assert got == rows(scan_workload(points, workload)) and got


def test_workload_by_shuffle_with_split_partitions(spark, sf_dir):
    points = i.points(spark, sf_dir)
    model = build("quadtree", spark, points, capacity=200)
    window = 500_000
    keyed = partition.partition_points(points, model, window)
    workload = i.circles(spark, sf_dir).withColumn("r", F.col("r") * 10)
    want = rows(scan_workload(points, workload))
    counts = partition.partition_counts(keyed)
    for given in (None, counts):
        got = queries.workload_points(keyed, workload, model, window, given, broadcast_rows=0, split_points=20)
        assert rows(got.select(*HIT)) == want and want
    whole = queries.workload_points(keyed, workload, model, window, broadcast_rows=0)
    assert rows(whole.select(*HIT)) == want


def test_long_intervals_use_coarser_blocks(spark, sf_dir):
    points = i.points(spark, sf_dir)
    model = build("quadtree", spark, points)
    window = 100
    keyed = partition.partition_points(points, model, window)
    workload = i.circles(spark, sf_dir).withColumn(
        "tb", F.expr("ta + CASE query_id % 150 WHEN 0 THEN 50 WHEN 50 THEN 5000 ELSE 4000000 END")
    ).withColumn("ta", F.expr("IF(query_id % 100 = 0, -3000000, ta)"))
    keys = candidates.candidate_join_keys(workload, model, window)
    per_region = keys.groupBy("query_id", "loc").count().agg(F.max("count")).first()[0]
    assert per_region <= candidates.SPAN + 1
    assert keys.select("scale").distinct().count() > 2
    got = rows(queries.workload_points(keyed, workload, model, window).select(*HIT))
    assert got == rows(scan_workload(points, workload)) and got
    got = queries.workload_points(keyed, workload, model, window, broadcast_rows=0, split_points=5)
    assert rows(got.select(*HIT)) == rows(scan_workload(points, workload))


def answers(spark, q, kind="quadtree", window=3):
    points = points_of(spark, EDGE_POINTS)
    model = build(kind, spark, points, capacity=1)
    keyed = partition.partition_points(points, model, window)
    nested = queries.build_trajectories(queries.query_points(keyed, model, window, q))
    return {r["traj_id"]: [tuple(p) for p in r["points"]] for r in nested.collect()}


@pytest.mark.parametrize("kind", KINDS)
def test_edges(kind, spark):
    assert answers(spark, CircleQuery(0.0, 0.0, 5.0, 0, 100), kind) == {"rim": [(10, 3.0, 4.0)]}
    assert set(answers(spark, BoxQuery(4.0, 8.0, 4.0, 8.0, 10, 10), kind)) == {"edge"}
    assert set(answers(spark, BoxQuery(1000.0, 0.0, 1024.0, 10.0, 0, 100), kind)) == {"upper"}
    assert set(answers(spark, CircleQuery(5000.0, -7.0, 0.0, 10, 10), kind)) == {"far"}
    assert set(answers(spark, CircleQuery(5.0, 5.0, 1.0, -5, -5), kind)) == {"negative"}
    assert set(answers(spark, CircleQuery(5.0, 5.0, 1.0, -4, 1), kind)) == set()


def test_visits_merge_and_are_ordered(spark):
    got = answers(spark, BoxQuery(-10.0, -10.0, 2000.0, 2000.0, 0, 100))
    assert got["twice"] == [(20, 6.0, 6.0), (25, 900.0, 900.0), (30, 6.0, 6.0), (30, 7.0, 6.0)]


def test_empty_answers_keep_the_schema(spark):
    for q in (CircleQuery(5.0, 5.0, 9.0, 100, 0), BoxQuery(9.0, 9.0, 1.0, 1.0, 0, 100), CircleQuery(5.0, 5.0, -1.0, 0, 100)):
        assert answers(spark, q) == {}
    points = points_of(spark, EDGE_POINTS)
    model = build("quadtree", spark, points)
    keyed = partition.partition_points(points, model, 3)
    none = spark.createDataFrame([(1, 5.0, 5.0, 9.0, 100, 0)], "query_id bigint, x double, y double, r double, ta bigint, tb bigint")
    empty = queries.circle_workload(keyed, none, model, 3)
    assert empty.columns == ["query_id", "traj_id", "part", "points"] and empty.count() == 0
    counts = queries.query_result_counts(none, queries.workload_points(keyed, none, model, 3))
    assert rows(counts) == [(1, 0, 0)]


def test_many_regions_are_joined_instead_of_listed(spark, sf_dir, monkeypatch):
    points = i.points(spark, sf_dir)
    model = build("quadtree", spark, points, capacity=20)
    keyed = partition.partition_points(points, model, i.WINDOW)
    monkeypatch.setattr(queries, "LISTED_REGIONS", 0)
    for q in (i.CIRCLE, CircleQuery(1.0, 1.0, 400.0, 0, 10**7)):
        got = rows(queries.query_points(keyed, model, i.WINDOW, q).select(*HIT))
        assert got == rows(queries.scan_points(points, q).select(*HIT)) and got


def test_candidates_equal_a_nested_loop(spark, sf_dir):
    points = i.points(spark, sf_dir)
    shapes = i.circles(spark, sf_dir)
    wide = shapes.withColumns({"query_id": F.col("query_id") + 10**6, "r": F.col("r") * 40})
    tiny = shapes.withColumns({"query_id": F.col("query_id") + 2 * 10**6, "r": F.lit(0.0)})
    off = shapes.withColumns({"query_id": F.col("query_id") + 3 * 10**6, "x": F.col("x") - 500.0})
    workload = shapes.unionByName(wide).unionByName(tiny).unionByName(off)
    for kind in KINDS:
        model = build(kind, spark, points, capacity=20)
        pad = model.bounds.pad
        dx = f"greatest(x0 - {pad} - x, 0, x - x1 - {pad})"
        dy = f"greatest(y0 - {pad} - y, 0, y - y1 - {pad})"
        loop = workload.join(model.regions.select("loc", "x0", "y0", "x1", "y1"), F.expr(f"{dx} * {dx} + {dy} * {dy} <= r * r"))
        got = candidates.candidate_regions(workload, model).select("query_id", "loc")
        assert rows(got.where("loc != 'outside'")) == rows(loop.select("query_id", "loc"))
        beyond = workload.where("NOT (x - r >= 0 AND x + r < 1024 AND y - r >= 0 AND y + r < 1024)")
        assert rows(got.where("loc = 'outside'").select("query_id")) == rows(beyond.select("query_id"))


def test_query_numbers_follow_submission(spark, sf_dir):
    numbered = queries.number_queries(i.circles(spark, sf_dir)).orderBy("issued_ms", "query_id").collect()
    assert [r["query_no"] for r in numbered] == list(range(1, len(numbered) + 1))


def test_one_moment_is_many_tasks(spark):
    crowd = spark.range(40_000).select(F.col("id").alias("query_id"), F.lit(7).cast("bigint").alias("issued_ms"))
    numbered = queries.number_queries(crowd.unionByName(crowd.limit(50)))
    assert numbered.where("query_no < query_id + 1 OR query_no > query_id + 51").count() == 0
    assert numbered.select("query_no").distinct().count() == 40_050 and numbered.agg(F.max("query_no")).first()[0] == 40_050
    tasks = gather.split_evenly(crowd, ["issued_ms", "query_id"], 8).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 3 * 40_000 / 8


def test_only_large_keys_are_written(spark, monkeypatch):
    written = []
    save = gather.publish
    monkeypatch.setattr(gather, "publish", lambda df, name: written.append((name, df.count())) or save(df, name))
    small = points_of(spark, [(f"t{k}", 1.0, 1.0, k) for k in range(500)] + [(None, 1.0, 1.0, k) for k in range(30)])
    assert gather.gather(small, ["traj_id"], ["t", "x", "y"], max_points=100).count() == 501 and not written
    hot = small.unionByName(points_of(spark, [("hot", 1.0, 1.0, k) for k in range(150)] + [(None, 2.0, 1.0, k) for k in range(100)]))
    nested = gather.gather(hot, ["traj_id"], ["t", "x", "y"], max_points=100)
    assert nested.agg(F.sum(F.size("points"))).first()[0] == 780 and [n for _, n in written] == [280]
    assert nested.where("traj_id IS NULL").count() == 2


def test_blocks_of_reversed_and_negative_intervals(spark):
    given = spark.createDataFrame([(-5, 7), (4, 4), (9, 2)], "ta bigint, tb bigint")
    got = given.select(candidates.blocks_for_interval(F.col("ta"), F.col("tb"), 3)).collect()
    assert [r[0] for r in got] == [[-1, 0, 1, 2], [1], []]


def test_gather_splits_large_keys(spark):
    hot = [("hot", float(n % 7), 1.0, n) for n in range(1000)]
    copies = [("copies", 1.0, 1.0, 5)] * 700
    small = [(f"t{n}", 1.0, 1.0, n) for n in range(50)]
    points = points_of(spark, hot + copies + small).repartition(6).withColumn("query_id", F.lit(1).cast("bigint"))
    nested = gather.build_trajectories(points, max_points=100)
    parts = nested.select("traj_id", "part", F.size("points").alias("n"), F.col("points")[0]["t"].alias("t0")).collect()
    assert max(r["n"] for r in parts) <= 100
    assert sum(r["n"] for r in parts if r["traj_id"] == "hot") == 1000
    assert sum(r["n"] for r in parts if r["traj_id"] == "copies") == 700
    assert all(r["part"] == 0 for r in parts if r["traj_id"].startswith("t"))
    in_order = [r["t0"] for r in sorted((r for r in parts if r["traj_id"] == "hot"), key=lambda r: r["part"])]
    assert len(in_order) >= 10 and in_order == sorted(in_order)
    flat = nested.selectExpr("query_id", "traj_id", "inline(points)").select(*HIT)
    assert rows(flat) == rows(points.select(*HIT))


def test_known_bound_saves_the_count(spark):
    points = points_of(spark, EDGE_POINTS).withColumn("query_id", F.lit(1))
    assert rows(gather.build_trajectories(points, longest=4)) == rows(gather.build_trajectories(points))


def test_parts_follow_from_the_data_alone(spark):
    rows = [("a", float(k % 7), 0.0, k % 50) for k in range(1000)] + [("b", 1.0, 1.0, 5)] * 3
    table = points_of(spark, rows)
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (2, 5, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        nested = gather.gather(table.repartition(n), ["traj_id"], ["t", "x", "y"], max_points=300).collect()
        seen.append(sorted((r["traj_id"], r["part"], [tuple(p) for p in r["points"]]) for r in nested))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    assert [(r[0], r[1], len(r[2])) for r in seen[0]] == [("a", 0, 300), ("a", 1, 300), ("a", 2, 300), ("a", 3, 100), ("b", 0, 3)]
    assert [p for r in seen[0][:4] for p in r[2]] == sorted((r[3], r[1], r[2]) for r in rows[:1000])


def test_open_intervals_cost_one_row_for_each_region(spark):
    table = points_of(spark, [("a", 5.0, 5.0, k * 10**9) for k in range(-3, 4)])
    model = models.build_grid(spark, i.BOUNDS, 4, 4)
    ends = [(1, -(2**63), 2**63 - 1), (2, 0, 2**63 - 1), (3, 0, 10**9), (4, -(2**63), -(2**63)), (5, 2 * 10**9, 2 * 10**9)]
    asked = spark.createDataFrame([(q, 5.0, 5.0, 1.0, a, b) for q, a, b in ends], "query_id long, x double, y double, r double, ta long, tb long")
    for window in (1, 20_000):
        keyed = partition.partition_points(table, model, window)
        hits = queries.workload_points(keyed, asked, model, window).groupBy("query_id").count()
        assert rows(hits) == [(1, 7), (2, 4), (3, 2), (5, 1)]
        held = candidates.existing_candidates(asked, model, window, partition.partition_counts(keyed)).groupBy("query_id").count()
        assert rows(held) == rows(hits)


def _plan_free_of_broadcast(spark, body):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return body()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_heavy_partitions_are_joined_as_grids(spark, sf_dir, broadcast_rows):
    points = i.points(spark, sf_dir)
    copies = points.where("event_id % 10 = 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("n")
    points = points.unionByName(copies.withColumns({"x": F.lit(7.0), "y": F.lit(7.0), "t": F.lit(500_000).cast("bigint")}))
    crowd = i.every_circle(spark, sf_dir).withColumns({"query_id": F.col("query_id") + 10**6, "x": F.lit(6.0), "y": F.lit(6.0), "r": F.lit(3.0), "ta": F.lit(0).cast("bigint"), "tb": F.lit(10**9).cast("bigint")})
    workload = i.circles(spark, sf_dir).unionByName(crowd.where("query_id % 3 = 0"))
    model = build("quadtree", spark, points, capacity=50)
    keyed = partition.partition_points(points, model, i.WINDOW)
    want = rows(scan_workload(points, workload))
    counts = partition.partition_counts(keyed)
    for given in (None, counts):
        got = queries.workload_points(keyed, workload, model, i.WINDOW, given, broadcast_rows=broadcast_rows, work=10_000)
        assert rows(got.select(*HIT)) == want and len(want) > 100_000


def test_cells_of_a_grid_are_even(spark):
    left = spark.range(9_000).select(F.lit(1).alias("k"), F.col("id").alias("l")).unionByName(spark.range(50).select(F.col("id").cast("int").alias("k"), F.col("id").alias("l")))
    right = spark.range(2_000).select(F.lit(1).alias("k"), F.col("id").alias("r")).unionByName(spark.range(50).select(F.col("id").cast("int").alias("k"), F.col("id").alias("r")))
    heavy, n, cells = dealing.heavy_keys(dealing.sizes(left, ["k"], "_l"), dealing.sizes(right, ["k"], "_r"), ["k"], 1_000_000, None)
    assert n == 1 and cells == 30
    met = dealing.dealt_join(left, right, ["k"], heavy, n, cells).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in met) == 9_001 * 2_001 and max(r["count"] for r in met) <= 6 * 1_000_000
    joined = dealing.spread_join(left, right, ["k"], 1_000_000)
    assert joined.count() == 9_001 * 2_001 + 49


def test_queries_meet_regions_without_broadcasts(spark, sf_dir):
    points = i.points(spark, sf_dir)
    workload = i.circles(spark, sf_dir)
    model = build("quadtree", spark, points, capacity=20)
    want = rows(candidates.candidate_regions(workload, model).select("query_id", "loc"))
    for work in (10**9, 500):
        got = _plan_free_of_broadcast(spark, lambda work=work: rows(candidates.candidate_regions(workload, model, broadcast_rows=0, work=work, rows=100).select("query_id", "loc")))
        assert got == want


def test_ranges_say_what_lists_say(spark, sf_dir):
    model = build("grid", spark, i.points(spark, sf_dir))
    workload = i.circles(spark, sf_dir)
    runs = candidates.candidate_ranges(workload, model, i.WINDOW).select("query_id", "loc", F.explode(F.expr("sequence(first_block, last_block)")).alias("block"))
    assert rows(runs) == rows(candidates.candidate_partitions(workload, model, i.WINDOW).select("query_id", "loc", "block"))
    ends = candidates.candidate_ranges(i.open_circles(spark, sf_dir), model, 1).select("first_block", "last_block").distinct()
    assert rows(ends) == [(-(2**63), 2**63 - 1)]
    assert candidates.candidate_ranges(workload.withColumn("ta", F.col("tb") + 1), model, 1).count() == 0


@pytest.mark.parametrize("kind", KINDS)
def test_workload_trajectories_move_no_hits(spark, kind):
    """Places beyond one mask, copies of a point, runs and gaps; shapes at edges of groups."""
    table = [("long", float(k % 9), float(k % 7), k) for k in range(150)] + [("twice", 3.0, 3.0, 5)] * 3
    table += [("one", 900.0, 900.0, 7), ("beyond", 2000.0, 3.0, 7), ("none", None, 3.0, 7)]
    points = points_of(spark, table)
    model = build(kind, spark, points, 5)
    asked = [(q, 2.0 + q % 5, 3.0, 1.0 + q % 4, q % 9, 20 * q) for q in range(12)] + [(90, 2000.0, 0.0, 5.0, 0, 99), (91, 900.0, 900.0, 0.0, 7, 7)]
    workload = spark.createDataFrame(asked, "query_id long, x double, y double, r double, ta long, tb long")
    got = queries.circle_workload(partition.partition_points(points, model, 10), workload, model, 10)
    want = {}
    for name, x, y, t in table:
        for q, cx, cy, r, ta, tb in asked:
            if x is not None and (x - cx) ** 2 + (y - cy) ** 2 <= r * r and ta <= t <= tb:
                want.setdefault((q, name, 0), []).append((t, x, y))
    found = {(r["query_id"], r["traj_id"], r["part"]): [tuple(p) for p in r["points"]] for r in got.collect()}
    assert found == {k: sorted(v) for k, v in want.items()} and len(found) > 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query_id" not in plan


def test_workload_with_repeated_ids_keeps_each_hit(spark):
    table = points_of(spark, [("a", 5.0, 5.0, 1), ("a", 6.0, 5.0, 2), (None, 5.0, 5.0, 3)])
    model = models.build_grid(spark, i.BOUNDS, 4, 4)
    workload = spark.createDataFrame([(1, 5.0, 5.0, 2.0, 0, 9)] * 2, "query_id long, x double, y double, r double, ta long, tb long")
    got = queries.circle_workload(partition.partition_points(table, model, 10), workload, model, 10).collect()
    assert sorted((r["traj_id"] or "", [p["t"] for p in r["points"]]) for r in got) == [("", [3, 3]), ("a", [1, 1, 2, 2])]


def test_join_of_few_bytes_takes_tasks_by_its_pairs(spark):
    left = spark.range(400).selectExpr("id % 20 AS k", "id AS a")
    joined = dealing.spread_join(left, left.withColumnRenamed("a", "b"), ["k"], task_pairs=500)
    assert joined.count() == 400 * 20
    assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_crowded_regions_are_grouped(spark, monkeypatch):
    """More regions where the queries are than cells of their level: the workload is still broadcast."""
    table = points_of(spark, [(str(k % 50), (k % 97) / 97, (k % 89) / 89, k) for k in range(2000)])
    model = models.build_kdtree(table, i.BOUNDS, 10)
    workload = spark.createDataFrame([(q, 0.5, 0.5, 0.5, 0, 9999) for q in range(20)], "query_id long, x double, y double, r double, ta long, tb long")
    monkeypatch.setattr(queries, "BROADCAST_ROWS", 500)
    keyed = partition.partition_points(table, model, 10_000)
    assert queries._dealt_sides(keyed, workload, model, 10_000, 40, queries.CUT_WORK, 500) is not None


def test_hot_workload_takes_few_keys_and_cells(spark, monkeypatch):
    """Queries over many small regions: few candidates, none broadcast for the size of their file, the same hits."""
    table = points_of(spark, [(str(k % 50), (k * 7 % 401) / 10, (k * 11 % 397) / 10, k - 40) for k in range(3000)] + EDGE_POINTS)
    model = models.build_quadtree(table, i.BOUNDS, 4, 8)
    keyed = partition.partition_points(table, model, 100)
    asked = [(q, 20.0 + q % 7, 20.0 + q % 5, 15.0, -30, 2000) for q in range(60)]
    workload = spark.createDataFrame(asked, "query_id long, x double, y double, r double, ta long, tb long")
    near = "p.t BETWEEN ta AND tb AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= r * r"
    want = keyed.alias("p").join(workload.alias("q"), F.expr(near)).select("query_id", "p.*")
    seen, publish = [], queries._published_keys
    monkeypatch.setattr(queries, "_published_keys", lambda *a: seen.append(publish(*a)) or seen[-1])
    for work in (300, 1 << 30):
        got = queries.workload_points(keyed, workload, model, 100, broadcast_rows=0, work=work)
        assert rows(got) == rows(want)
        plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not any("BroadcastHashJoin" in line and "_qta#" in line for line in plan)
    assert max(facts["n"] for _, facts in seen) < candidates.candidate_join_keys(workload, model, 100).count()


def test_cells_are_no_more_than_tasks(spark, monkeypatch):
    monkeypatch.setattr(dealing, "MAX_TASKS", 4)
    left = spark.range(9_000).selectExpr("1L AS k", "id AS a")
    sides = dealing.sizes(left, ["k"], "_l"), dealing.sizes(left.limit(2_000), ["k"], "_r")
    heavy, n, cells = dealing.heavy_keys(*sides, ["k"], 10_000, None)
    assert n == 1 and cells <= 6
    assert dealing.dealt_join(left, left.limit(2_000).withColumnRenamed("a", "b"), ["k"], heavy, n, cells).count() == 18_000_000


def test_result_counts_move_no_hits(spark, monkeypatch):
    """Many cells of few words, trajectories in several regions, points of none: counted in the task of their cell."""
    table = [(f"t{k % 300}", float(k * 7 % 401) / 10, float(k * 11 % 397) / 10, k - 40) for k in range(6000)] + [("copy", 20.0, 20.0, 5)] * 5
    table += [(None, 20.0, 20.0 + k % 3, k) for k in range(50)] + EDGE_POINTS
    points = points_of(spark, table)
    model = models.build_quadtree(points, i.BOUNDS, 4, 8)
    keyed = partition.partition_points(points, model, 100)
    asked = [(q, 20.0 + q % 17, 20.0 + q % 15, 1.0 + q % 9, -30, 300 * q) for q in range(60)] + [(90, 5000.0, 0.0, 9.0, 0, 99), (91, 5.0, 5.0, -1.0, 0, 99), (92, 1.0, 1.0, 9.0, 99, 0)]
    asked += [(7, 5.0, 5.0, 9.0, -30, 9000), asked[9], (None, 20.0, 20.0, 9.0, 0, 9000)]
    circles = spark.createDataFrame(asked, "query_id long, x double, y double, r double, ta long, tb long")
    boxes = circles.selectExpr("query_id", "x - r AS x0", "y - r AS y0", "x + r AS x1", "y + r AS y1", "ta", "tb")
    written = []
    save = queries.publish
    monkeypatch.setattr(queries, "publish", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, name))
    for name, n in (("CELL_KEYS", 60), ("CELL_WORDS", 2), ("NAMES", 100)):
        monkeypatch.setattr(queries, name, n)
    for workload in (circles, boxes):
        marked = queries.workload_points(keyed, workload, model, 100, marked=True)
        hits = scan_workload(points, workload)
        known = "query_id IS NOT NULL AND traj_id IS NOT NULL"
        assert rows(marked.select(*HIT).where(known)) == rows(hits.where(known)) and marked.count() == hits.count()
        assert marked.select("_cell").distinct().count() > 8
        want = queries.query_result_counts(workload, hits)
        got = queries.query_result_counts(workload, marked)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert len(written) == 2 and not any("Exchange hashpartitioning(_cell" in p and "_word" in line for p in written for line in p.splitlines() if "Exchange" in line)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_result_counts_of_long_trajectories(spark):
    """Where hits cannot be marked, they are counted as before; ids may repeat in both."""
    table = points_of(spark, [("a", 5.0, 5.0, 1), ("a", 6.0, 5.0, 2), (None, 5.0, 5.0, 3), ("b", 5.0, 5.0, 3)])
    model = models.build_grid(spark, i.BOUNDS, 4, 4)
    keyed = partition.partition_points(table, model, 10)
    twice = spark.createDataFrame([(1, 5.0, 5.0, 2.0, 0, 9)] * 2, "query_id long, x double, y double, r double, ta long, tb long")
    for work in (1 << 30, 1):
        hits = queries.workload_points(keyed, twice, model, 10, work=work, marked=True)
        assert ("_word" in hits.columns) == (work > 1)
        assert rows(queries.query_result_counts(twice, hits)) == [(1, 2, 8)] * 2


def test_large_workload_takes_coarser_blocks(spark, sf_dir, monkeypatch):
    """Too many rows with blocks of their own scale, even with one region: hits still stay in the task of their trajectory."""
    points, workload = i.points(spark, sf_dir), i.circles(spark, sf_dir)
    model = build("quadtree", spark, points, capacity=20)
    keyed = partition.partition_points(points, model, i.WINDOW)
    finest = min(rows for coarser, _, rows, _ in regroup.grains(workload, i.BOUNDS, i.WINDOW) if not coarser)
    limit = int(min(rows for _, _, rows, _ in regroup.grains(workload, i.BOUNDS, i.WINDOW))) + 1
    assert limit < finest / 2
    dealt = queries._dealt_sides
    monkeypatch.setattr(queries, "_dealt_sides", lambda *a: dealt(*a, broadcast_rows=limit))
    got = queries.circle_workload(keyed, workload, model, i.WINDOW)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query_id" not in plan
    assert rows(got.selectExpr("query_id", "traj_id", "inline(points)").select(*HIT)) == rows(scan_workload(points, workload))


def test_points_of_marked_places(spark):
    """Few and many places, runs and gaps, over one number of marks and several."""
    held = [(k, float(k % 5), float(k)) for k in range(150)]
    for masks in (1, 2, 3, 4):
        last = min(150, masks * queries.BITS)
        kinds = [[0], [last - 1], [0, last - 1], [3, 5, 7], [*range(9, 30)], [0, 1, 2, 5, 9, 30], [*range(0, last, 7)], [1, 2, 3, 4, 5, 61], [last - 4, last - 2, last - 1], [*range(last)]]
        marked = [(q, "a", len(p), p[0], p[-1], held, *(sum(1 << (v % queries.BITS) for v in p if v // queries.BITS == k) for k in range(masks))) for q, p in enumerate(kinds)]
        marks = "".join(f", _m{k} long" for k in range(masks))
        met = spark.createDataFrame(marked, "query_id long, traj_id string, _n int, _first int, _last int, _all array<struct<t: long, x: double, y: double>>" + marks)
        got = {r["query_id"]: [p["t"] for p in r["points"]] for r in queries._with_points(met, masks).collect()}
        assert got == dict(enumerate(kinds))


def test_only_tables_of_one_row_a_key_are_not_grouped(spark):
    points = points_of(spark, EDGE_POINTS)
    model = build("grid", spark, points)
    workload = spark.createDataFrame([(1, 5.0, 5.0, 9.0, 0, 99), (2, 900.0, 900.0, 1.0, 0, 99)], "query_id long, x double, y double, r double, ta long, tb long")
    nested = queries.circle_workload(partition.partition_points(points, model, 10), workload, model, 10)
    keys = ["query_id", "traj_id"]
    flat = gather.summarize(nested, keys)
    assert "Aggregate" not in flat._jdf.queryExecution().optimizedPlan().toString().split("points")[0]
    assert rows(flat) == rows(gather.summarize(nested.select("*"), keys)) and flat.count() > 3
    twice = gather.summarize(nested.unionByName(nested), keys)
    assert rows(twice) == [(q, name, 2 * n, *ends) for q, name, n, *ends in rows(flat)]
    assert rows(gather.summarize(nested, ["query_id"])) == rows(gather.summarize(nested.select("*"), ["query_id"]))
