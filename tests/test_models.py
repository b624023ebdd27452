"""Regions tile the bounds, hold what they may, and every point has exactly one."""

import math
import random
import struct
from dataclasses import replace

import pytest
from helpers import EDGE_POINTS, KINDS, build, points_of, rows
from pyspark.sql import functions as F

from geotrail import Bounds
from geotrail.operators import assign, cuts, models, sample
from geotrail.plans import inputs as i


@pytest.mark.parametrize("kind", KINDS)
def test_every_point_lies_in_the_box_of_its_region(kind, spark, sf_dir):
    points = i.points(spark, sf_dir)
    model = build(kind, spark, points, capacity=20)
    assigned = assign.assign_regions(points, model)
    assert assigned.count() == points.count()
    held = assigned.join(model.regions.select("loc", "x0", "y0", "x1", "y1"), "loc")
    assert held.where("x >= x0 AND x < x1 AND y >= y0 AND y < y1").count() == points.count()


@pytest.mark.parametrize("kind", ["grid", "quadtree", "kdtree"])
def test_regions_tile_the_bounds(kind, spark, sf_dir):
    regions = build(kind, spark, i.points(spark, sf_dir), capacity=20).regions
    area = regions.agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)"))).first()[0]
    assert area == pytest.approx(i.BOUNDS.width * i.BOUNDS.height)
    overlaps = regions.alias("a").join(
        regions.alias("b"),
        F.expr("a.loc < b.loc AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"),
    )
    assert overlaps.count() == 0


def test_no_region_above_the_deepest_level_exceeds_capacity(spark, sf_dir):
    points = i.points(spark, sf_dir)
    model = build("quadtree", spark, points, capacity=20)
    counts = assign.assign_regions(points, model).groupBy("loc").count()
    full = counts.join(model.regions, "loc").where(f"level < {i.MAX_DEPTH} AND count > 20")
    assert full.count() == 0
    assert sum(model.shape["regions_at"]) == model.regions.count()


def test_kd_leaves_are_even(spark, sf_dir):
    points = i.points(spark, sf_dir)
    model = build("kdtree", spark, points, capacity=100)
    counts = [r["count"] for r in assign.assign_regions(points, model).groupBy("loc").count().collect()]
    assert len(counts) == 2 ** model.shape["depth"]
    assert max(counts) <= 110 and sum(counts) == points.count()


ODD_DOUBLES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1e308, 1e16, float("inf"), float("-inf")]


def test_sort_keys_order_like_doubles(spark):
    rng = random.Random(3)
    numbers = ODD_DOUBLES + [math.ldexp(1.0, e) for e in range(-1074, 1024)] + [math.nextafter(math.ldexp(1.0, e), d) for e in range(-1000, 1000, 7) for d in (-math.inf, math.inf)]
    numbers += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)]
    numbers = [v for v in numbers if v == v] + [-v for v in numbers if v == v]
    keys = {r["v"]: r["k"] for r in spark.createDataFrame([(v,) for v in numbers], "v double").selectExpr("v", f"{cuts.sort_key('v')} AS k").collect()}
    for v, k in keys.items():
        raw = struct.unpack("q", struct.pack("d", abs(v)))[0]
        assert k == (raw if v > 0 else -raw), v
    nan, top = spark.sql(f"SELECT {cuts.sort_key('v')} AS k FROM VALUES (double('NaN')), (double('Infinity')) AS t(v)").collect()
    assert nan["k"] > top["k"]


@pytest.mark.parametrize("opened", [10**9, 50, 3])
def test_selected_cuts_are_those_of_sorting(spark, monkeypatch, opened):
    monkeypatch.setattr(cuts, "OPENED", opened)
    monkeypatch.setattr(cuts, "LEADING_BITS", 13 if opened > 3 else 4)
    shapes = {1: lambda k: (k * 7919) % 5003 / 5, 2: lambda k: 1.0 if k % 3 else 2.0**-k, 3: lambda k: -1e300 * (k % 7), 4: lambda k: k, 5: lambda k: 7.5}
    rows = [(node, float(f(k))) for node, f in shapes.items() for k in range(node * 150 if node < 4 else 2)]
    table = spark.createDataFrame(rows, "node long, v double").selectExpr("node", f"{cuts.sort_key('v')} AS k", "v").repartition(5)
    low, high = table.agg(F.min("k"), F.max("k")).first()
    for parts in (2, 7, 400):
        found = cuts.select_cuts(table, parts, len(rows), 10**6 if opened < 10**6 else 1, low, high).collect()
        got = {r["node"]: (r["n"], [(c["i"], c["v"], c["below"]) for c in r["cuts"]]) for r in found}
        for node in shapes:
            own = sorted(v for n, v in rows if n == node)
            want = [own[math.ceil(i / parts * len(own)) - 1] for i in range(1, parts)]
            assert got[node] == (len(own), [(i, v, sum(o < v for o in own)) for i, v in enumerate(want, 1)]), (node, parts)


def test_trees_of_several_storeys(spark, sf_dir, monkeypatch):
    points = i.points(spark, sf_dir)
    want = {kind: (rows(m.regions.select("loc", "x0", "y0", "x1", "y1")), rows(assign.assign_regions(points, m).select("event_id", "loc"))) for kind in ("kdtree", "strtree") for m in [build(kind, spark, points, capacity=7)]}
    monkeypatch.setattr(models, "TOP_LEVELS", 3)
    monkeypatch.setattr(models, "LOWER_LEVELS", 2)
    monkeypatch.setattr(models, "PACKED", 10)
    for limit, chained in ((1 << 26, 3), (0, 50), (0, 200)):
        monkeypatch.setattr(models, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(models, "CHAINED", chained)
        for kind in want:
            model = build(kind, spark, points, capacity=7)
            assert len(models.storeys(model.shape.get("depth", 0))) > 2 or kind == "strtree"
            found = rows(assign.assign_regions(points, model).select("event_id", "loc"))
            assert (rows(model.regions.select("loc", "x0", "y0", "x1", "y1")), found) == want[kind]
            kept = replace(model, top=None)
            assert rows(assign.assign_regions(points, kept).select("event_id", "loc")) == found


def test_over_full_leaves_are_counted(spark):
    assert models.build_quadtree(points_of(spark, [("a", 5.0, 5.0, 1)] * 50), i.BOUNDS, 10).shape["over_full"] == 1


def test_edge_points(spark):
    points = points_of(spark, EDGE_POINTS)
    model = models.build_grid(spark, i.BOUNDS, 256, 256)
    loc = {(r["traj_id"], r["x"]): r["loc"] for r in assign.assign_regions(points, model).collect()}
    assert loc[("upper", 1024.0)] == loc[("far", 5000.0)] == "outside"
    boxes = {r["loc"]: r for r in model.regions.collect()}
    on_edge = boxes[loc[("edge", 4.0)]]
    assert (on_edge["x0"], on_edge["y0"]) == (4.0, 8.0)
    assert all(v in boxes for k, v in loc.items() if k[0] not in ("upper", "far"))


@pytest.mark.parametrize("kind", KINDS)
def test_models_of_copies_and_of_nothing(kind, spark):
    copies = points_of(spark, [("a", 5.0, 5.0, 1)] * 500)
    for points in (copies, copies.where("false")):
        model = build(kind, spark, points, capacity=10)
        assert assign.assign_regions(copies, model).groupBy("loc").count().count() == 1
        assert model.regions.count() >= 1


def test_bounds_that_are_not_powers_of_two(spark, sf_dir):
    bounds = Bounds(-1.0, -1.0, 1001.0, 1001.0)
    points = i.points(spark, sf_dir)
    model = models.build_quadtree(points, bounds, 10, 8)
    assigned = assign.assign_regions(points, model).join(model.regions.select("loc", "x0", "y0", "x1", "y1"), "loc")
    pad = bounds.pad
    inside = f"x >= x0 - {pad} AND x < x1 + {pad} AND y >= y0 - {pad} AND y < y1 + {pad}"
    assert assigned.where(inside).count() == points.count()


def test_large_quadtrees_do_not_force_a_broadcast(spark, sf_dir, monkeypatch):
    points = i.points(spark, sf_dir)
    model = build("quadtree", spark, points, capacity=20)
    want = rows(assign.assign_regions(points, model).select("event_id", "loc"))
    monkeypatch.setattr(assign, "BROADCAST_ROWS", 0)
    assert rows(assign.assign_regions(points, model).select("event_id", "loc")) == want


def test_sample_is_whole_trajectories_and_repeatable(spark, sf_dir):
    points = i.points(spark, sf_dir)
    sizes = {r["traj_id"]: r["count"] for r in points.groupBy("traj_id").count().collect()}
    first = sample.sample_trajectories(points, 5, seed=1).groupBy("traj_id").count().collect()
    again = sample.sample_trajectories(points.repartition(5), 5, seed=1).groupBy("traj_id").count().collect()
    assert {tuple(r) for r in first} == {tuple(r) for r in again}
    assert len(first) == 5 and all(sizes[r["traj_id"]] == r["count"] for r in first)
    assert sample.sample_trajectories(points, 10**6).count() == points.count()


def test_sampled_model_covers_all_points(spark, sf_dir):
    points = i.points(spark, sf_dir)
    for kind in KINDS:
        model = build(kind, spark, sample.sample_trajectories(points, 3), capacity=20)
        assigned = assign.assign_regions(points, model)
        assert assigned.where("loc IS NULL OR loc = 'outside'").count() == 0


def test_depth_follows_the_data(spark):
    rng = random.Random(5)
    tight = [("a", 10 + rng.random() / 4096, 10 + rng.random() / 4096, 1) for _ in range(300)]
    pile = [("b", 900.0, 900.0, 1)] * 60
    wide = [("c", rng.random() * 1024, rng.random() * 1024, 1) for _ in range(300)]
    points = points_of(spark, tight + pile + wide)
    model = models.build_quadtree(points, i.BOUNDS, 10)
    assert model.shape["max_depth"] > 16 and model.shape["over_full"] == 1  # the pile cannot be split
    assigned = assign.assign_regions(points, model)
    counts = {r["loc"]: r["count"] for r in assigned.groupBy("loc").count().collect()}
    assert sorted(counts.values())[-2:] == [max(n for n in counts.values() if n < 60), 60] and sorted(counts.values())[-2] <= 10
    held = assigned.join(model.regions, "loc").where("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    assert held.count() == points.count()
    assert model.regions.agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)"))).first()[0] == i.BOUNDS.width * i.BOUNDS.height
    assert sum(model.shape["regions_at"]) == model.regions.count()


def test_a_depth_from_the_data_agrees_with_a_given_one(spark, sf_dir):
    odd = Bounds(-3.7, 11.1, 987.3, 1001.9)
    points = i.points(spark, sf_dir)
    free = models.build_quadtree(points, odd, 20)
    given = models.build_quadtree(points, odd, 20, free.shape["max_depth"])
    assert free.shape == given.shape and free.shape["over_full"] == 0
    assert rows(free.regions) == rows(given.regions)
    for empty in (points.limit(0), points.where("x < -100")):
        assert rows(models.build_quadtree(empty, odd, 20).regions.select("loc")) == [("q",)]
