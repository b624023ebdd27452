"""Spatial models: tables of regions, built by Spark from a sample of points.

Every model is a regions table ``loc, x0, y0, x1, y1`` of half-open boxes (the
quadtree and the grid also carry their integer cells), plus what the assignment of
points needs. Model tables are as small as the model, never as large as the data.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotrail.functions.cells import cell, coarser
from geotrail.functions.predicates import box_touches_region, circle_touches_region, in_bounds
from geotrail.functions.sqltext import sql
from geotrail.operators.cuts import PACKED, in_heap, in_order, packed, select_cuts, sort_key, walk
from geotrail.params import Bounds, require_positive
from geotrail.scratch import publish, publish_with_facts


@dataclass(frozen=True)
class SpatialModel:
    """A built model. ``kind`` is grid, quadtree, kdtree or strtree.

    ``cuts`` is the table of cuts of a k-d or STR model; ``top`` holds those that every
    point meets, if they are at hand.
    """

    kind: str
    bounds: Bounds
    regions: DataFrame
    shape: dict = field(default_factory=dict)
    cuts: DataFrame | None = None
    top: list[float] | None = None


def model_size(model: SpatialModel) -> DataFrame:
    """One row: the number of regions."""
    return model.regions.agg(F.count("*").alias("n_regions"))


def model_regions(model: SpatialModel) -> int:
    """The number of regions, from the shape of the model alone."""
    shape = model.shape
    sizes = {"grid": lambda: shape["n"] * shape["m"], "quadtree": lambda: sum(shape["regions_at"]), "kdtree": lambda: 2 ** shape["depth"]}
    return sizes[model.kind]() if model.kind in sizes else shape["side"] ** 2


def _box(ix: str, iy: str, nx: str, ny: str, bounds: Bounds) -> list[str]:
    """Edges of a cell; the same integers always give the same edge."""

    def edge(i: str, n: str, low: float, size: float) -> str:
        return f"{sql(float(low))} + {i} * {sql(size)} / {n}"

    return [
        edge(ix, nx, bounds.min_x, bounds.width) + " AS x0",
        edge(iy, ny, bounds.min_y, bounds.height) + " AS y0",
        edge(f"({ix} + 1)", nx, bounds.min_x, bounds.width) + " AS x1",
        edge(f"({iy} + 1)", ny, bounds.min_y, bounds.height) + " AS y1",
    ]


# ---- grid -------------------------------------------------------------------------


def build_grid(spark: SparkSession, bounds: Bounds, n: int, m: int) -> SpatialModel:
    """``n`` columns by ``m`` rows of equal cells."""
    require_positive(n=n, m=m)
    regions = (
        spark.range(n * m)
        .selectExpr(f"id div {m} AS ix", f"id % {m} AS iy")
        .selectExpr("concat('g', ix, '_', iy) AS loc", "ix", "iy", *_box("ix", "iy", sql(float(n)), sql(float(m)), bounds))
    )
    return SpatialModel("grid", bounds, regions, {"n": n, "m": m})


# ---- quadtree ---------------------------------------------------------------------


STEP = 8
"""Levels that one pass over the sample counts while the depth is taken from the data."""
DEEPEST = 30
"""Depth at which a quadtree ends in any case: two cell numbers still make one long key."""


def quadtree_counts(
    sample: DataFrame, bounds: Bounds, max_depth: int, first: int = 0, crowded: DataFrame | None = None, places: bool = False
) -> DataFrame:
    """Points in each non-empty cell of the levels from ``first`` on: ``level, ix, iy, n``.

    Points are first counted in the finest cells, map side, so that a crowded place is
    a number before anything is shuffled; the coarser levels add up those numbers.
    ``crowded`` are cells ``ix, iy`` of the level above ``first``, outside which nothing is
    counted. ``places`` adds ``spread``: whether the points of a cell lie at several places.
    """
    ends = [f(c).alias(f.__name__ + c) for c in "xy" for f in (F.min, F.max)] if places else []
    finest = (
        sample.where(in_bounds("x", "y", bounds))
        .selectExpr(
            cell("x", bounds.min_x, bounds.width, max_depth) + " AS fx",
            cell("y", bounds.min_y, bounds.height, max_depth) + " AS fy",
            *(["x", "y"] if places else []),
        )
        .groupBy("fx", "fy")
        .agg(F.count("*").alias("n"), *ends)
    )
    if crowded is not None:
        above = max_depth - first + 1
        finest = finest.join(crowded, F.expr(f"{coarser('fx', above)} = ix AND {coarser('fy', above)} = iy"), "left_semi")
    up = f"{max_depth} - level"
    again = [F.min("minx") < F.max("maxx"), F.min("miny") < F.max("maxy")] if places else []
    return (
        finest.selectExpr("*", f"explode(sequence({first}, {max_depth})) AS level")
        .withColumns({"ix": F.expr(coarser("fx", up)), "iy": F.expr(coarser("fy", up))})
        .groupBy("level", "ix", "iy")
        .agg(F.sum("n").alias("n"), *([(again[0] | again[1]).alias("spread")] if places else []))
    )


def _counts_to_any_depth(sample: DataFrame, bounds: Bounds, capacity: int) -> tuple[DataFrame, int]:
    """Counts of all levels down to the first at which no cell is to be split, and that level.

    Every pass goes ``STEP`` levels deeper and counts only what lies in cells that are still
    crowded, so the passes follow from the depth and not from the number of points.
    """
    done, crowded, first = [], None, 0
    for last in range(STEP, DEEPEST + STEP, STEP):
        last = min(last, DEEPEST)
        split = (F.col("level") == last) & (F.col("n") > capacity) & F.col("spread")
        counts, facts = publish_with_facts(
            quadtree_counts(sample, bounds, last, first, crowded, places=True), "quadtree-counts", F.count_if(split).alias("left")
        )
        done.append(counts)
        if not facts["left"]:
            break
        crowded, first = counts.where(split).select("ix", "iy"), last + 1
    return reduce(DataFrame.unionByName, done), last


QUADTREE_NAME = """concat('q', array_join(transform(
    CASE WHEN level > 0 THEN sequence(1, level) ELSE CAST(array() AS ARRAY<INT>) END,
    i -> string(shiftright(ix, level - i) % 2 + shiftright(iy, level - i) % 2 * 2)), ''))"""
"""``q`` and one base-4 digit for each level, the coarsest first."""


def build_quadtree(sample: DataFrame, bounds: Bounds, capacity: int, max_depth: int | None = None) -> SpatialModel:
    """Splits a node in four while it holds more than ``capacity`` sample points.

    Split nodes name themselves and their four children; the nodes never named as split
    are the leaves, empty ones included, so they tile the bounds. Keys stay integers; the
    name comes last.

    Without ``max_depth`` the depth follows from the data: only cells whose points all lie at
    one place, and those of level ``DEEPEST``, stay over-full. With it, leaves of that level
    are not split. How many leaves hold more than ``capacity`` is logged and in
    ``shape["over_full"]``.
    """
    require_positive(capacity=capacity)
    full = F.col("n") > capacity
    if max_depth is None:
        counts, limit = _counts_to_any_depth(sample, bounds, capacity)
        split = counts.where(full & F.col("spread") & (F.col("level") < limit))
    else:
        require_positive(max_depth=max_depth)
        counts, limit = publish(quadtree_counts(sample, bounds, max_depth), "quadtree-counts"), max_depth
        split = counts.where(full & (F.col("level") < limit))

    named = """inline(array(named_struct('level', level, 'ix', ix, 'iy', iy, 'is_split', true), {}))""".format(
        ", ".join(
            f"named_struct('level', level + 1, 'ix', ix * 2 + {q % 2}, 'iy', iy * 2 + {q // 2}, 'is_split', false)"
            for q in range(4)
        )
    )
    root = sample.sparkSession.range(1).selectExpr("0 AS level", "0L AS ix", "0L AS iy", "false AS is_split")
    leaves = (
        split.selectExpr(named)
        .unionByName(root)
        .groupBy("level", "ix", "iy")
        .agg(F.max("is_split").alias("is_split"))
        .where("NOT is_split")
    )
    leaves = leaves.join(counts.where(full).select("level", "ix", "iy", F.lit(True).alias("is_full")), ["level", "ix", "iy"], "left")
    regions, seen = publish_with_facts(
        leaves.selectExpr(
            f"{QUADTREE_NAME} AS loc", "level", "ix", "iy", *_box("ix", "iy", "power(2D, level)", "power(2D, level)", bounds), "is_full"
        ),
        "quadtree",
        F.count_if("is_full").alias("over_full"),
        *(F.expr(f"count_if(level = {n})").alias(str(n)) for n in range(limit + 1)),
    )
    depth = max_depth or max(n for n in range(limit + 1) if n < 2 or seen[str(n)])
    if seen["over_full"]:
        logging.getLogger(__name__).warning("quadtree: %d leaves hold more than %d points", seen["over_full"], capacity)
    shape = {"max_depth": depth, "regions_at": [seen[str(n)] for n in range(depth + 1)], "over_full": seen["over_full"]}
    return SpatialModel("quadtree", bounds, regions.drop("is_full"), shape)


# ---- k-d tree ---------------------------------------------------------------------

TOP_LEVELS = 16
"""Levels of a k-d tree that are one array in the plan: 65,535 cuts."""
LOWER_LEVELS = 10
"""Levels below that are one row of the table of cuts: 1,023 cuts, 8 KB."""
BROADCAST_BYTES = 64 << 20
"""Largest table of cuts that is broadcast."""
CHAINED = 30_000
"""Most points of a node whose whole subtree is found in one task."""
TASK_POINTS = 250_000
"""Points of a task that finds subtrees, about."""


def storeys(depth: int) -> list[tuple[int, int]]:
    """First level and number of levels of each storey of a k-d tree."""
    out = [(0, min(depth, TOP_LEVELS))]
    while sum(out[-1]) < depth:
        out.append((sum(out[-1]), min(LOWER_LEVELS, depth - sum(out[-1]))))
    return out


def build_kdtree(sample: DataFrame, bounds: Bounds, capacity: int) -> SpatialModel:
    """Halves every node at its median, x and y in turn, until nodes fit ``capacity``.

    Medians are exact. Those of a level are found together, in a few passes over the sample;
    once no node holds more than ``CHAINED`` points, all levels below are found in one. The
    cuts are kept in storeys, tables ``tree, cuts``: the array of a row holds the cuts of a
    subtree, level after level, infinity where there is none. A node without sample points
    is not cut: its left child keeps the whole box and its right child is empty.
    """
    require_positive(capacity=capacity)
    spark = sample.sparkSession
    inside, facts = _keyed(sample.where(in_bounds("x", "y", bounds)))
    n = largest = facts["n"]
    depth = max(0, math.ceil(math.log2(n / capacity))) if n else 0
    inside, top, tables = inside.withColumn("_tree", F.expr("1L")), [], []
    for start, levels in storeys(depth):
        if start:
            inside = publish(_walk_kd(inside, tables[-1], top, *storeys(start)[-1]).hint("rebalance", "_tree"), "kdtree-sample")
            largest = inside.groupBy("_tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        table, found, level = None, [], start
        while level < start + levels:
            here = _walk_kd(inside, table, top, start, level - start) if level > start else inside
            if largest <= CHAINED:
                cuts, following = _chained_cuts(here, n, level, start + levels), start + levels
            else:
                axis, following = "xy"[level % 2], level + 1
                rows = here.select(F.col("_tree").alias("node"), F.col(f"k{axis}").alias("k"), F.col(axis).alias("v"))
                cuts = select_cuts(rows, 2, n, largest, facts[f"low_{axis}"], facts[f"high_{axis}"])
                cuts = cuts.selectExpr("node", "cuts[0].v AS v", "greatest(cuts[0].below, n - cuts[0].below) AS larger")
            if start:
                cuts, seen = publish_with_facts(cuts, "kdtree-cuts", F.max("larger").alias("larger"))
                largest, found = seen["larger"] or largest, [*found, cuts]
                table = publish(_subtrees(reduce(DataFrame.unionByName, found), start, following), "kdtree-subtrees")
            else:
                own = {r["node"]: r for r in cuts.collect()}
                top += [own[k]["v"] if k in own else math.inf for k in range(2**level, 2**following)]
                largest = max((r["larger"] or largest for r in own.values()), default=largest)
            level = following
        tables.append(table if start else spark.createDataFrame([(1, top)], "tree long, cuts array<double>"))
    cuts = publish(reduce(DataFrame.unionByName, tables), "kdtree-table") if len(tables) > 1 else tables[0]
    model = SpatialModel("kdtree", bounds, None, {"depth": depth}, cuts, top)
    return replace(model, regions=publish(_kd_regions(model), "kdtree"))


def _chained_cuts(rows: DataFrame, n: int, level: int, until: int) -> DataFrame:
    """Medians of all nodes from ``level`` to ``until``: ``node, v, larger``; larger is null.

    ``_tree`` names nodes of few points. They are moved once, neighbours to one task; the
    levels below follow in that task, each a sort and a running number.
    """
    spark = rows.sparkSession
    tasks = min(2**level, max(spark.sparkContext.defaultParallelism, -(-n // TASK_POINTS)))
    none = F.array().cast("array<struct<node: bigint, v: double>>")
    task = F.expr(f"int((_tree - {2**level}L) * {tasks}L div {2**level}L)").alias("_task")
    walked = rows.select(task, F.col("_tree").alias("_node"), "x", "y", "kx", "ky", none.alias("_found")).repartitionById(tasks, "_task")
    for k in range(level, until):
        axis = "xy"[k % 2]
        own = Window.partitionBy("_task", "_node").orderBy(f"k{axis}")
        every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        one = F.count(F.lit(1))
        walked = walked.withColumns({"_n": one.over(every), "_place": F.row_number().over(own), "_upto": one.over(own)})
        middle = F.ceil(F.col("_n") * F.lit(0.5))
        cut = F.array(F.struct(F.col("_node").alias("node"), F.col(axis).alias("v")))
        found = F.when(F.col("_place") == middle, F.concat("_found", cut)).otherwise(F.col("_found"))
        # at or above the median are the rows with so many rows up to their value
        node = F.col("_node") * 2 + F.when(F.col("_upto") >= middle, 1).otherwise(0)
        walked = walked.select("_task", node.alias("_node"), "x", "y", "kx", "ky", found.alias("_found"))
    return walked.select(F.inline("_found")).withColumn("larger", F.lit(None).cast("long"))


def _subtrees(cuts: DataFrame, start: int, until: int) -> DataFrame:
    """Arrays of the cuts (node, v) below the nodes of level ``start``, level after level."""
    deep = F.length(F.bin("node")) - 1 - start
    tree = F.call_function("shiftright", "node", deep)
    place = F.col("node") - F.call_function("shiftleft", tree, deep) + F.call_function("shiftleft", F.lit(1).cast("long"), deep) - 1
    own = cuts.select(tree.alias("tree"), F.struct(place.alias("place"), "v").alias("own")).groupBy("tree").agg(F.map_from_entries(F.collect_list("own")).alias("own"))
    places = F.sequence(F.lit(0), F.lit(2 ** (until - start) - 2))
    return own.select("tree", F.transform(places, lambda k: F.coalesce(F.try_element_at("own", k.cast("long")), F.lit(math.inf))).alias("cuts"))


def _walk_kd(points: DataFrame, table: DataFrame | None, top: list[float], start: int, levels: int) -> DataFrame:
    """Moves ``_tree``, the heap number of a node at level ``start``, down by ``levels``.

    The first storey is an array in the plan. For a lower one, points meet the array of
    their subtree; the path through it is generated code again.
    """
    value = lambda level: F.col("xy"[(start + level) % 2])
    if not start:
        walked = walk(points, "_path", packed(top[: 2**levels - 1]), levels, in_heap, value)
    else:
        held = table.select(F.col("tree").alias("_tree"), F.col("cuts").alias("_cuts"))
        small = 2 ** (start + levels) * 8 <= BROADCAST_BYTES
        met = points.join(F.broadcast(held) if small else held, "_tree", "left")
        walked = walk(met, "_path", F.col("_cuts"), levels, in_heap, value).drop("_cuts")
    return walked.withColumn("_tree", F.shiftleft("_tree", levels) + F.col("_path")).drop("_path")


def walk_kdtree(points: DataFrame, model: SpatialModel) -> DataFrame:
    """Adds ``_tree``: heap number of the leaf that holds the point."""
    walked, top = points.withColumn("_tree", F.expr("1L")), top_cuts(model)
    for start, levels in storeys(model.shape["depth"]):
        if levels:
            walked = _walk_kd(walked, _storey(model, start), top, start, levels)
    return walked


def _storey(model: SpatialModel, start: int) -> DataFrame:
    return model.cuts.where((F.col("tree") >= 2**start) & (F.col("tree") < 2 ** (start + 1)))


def top_cuts(model: SpatialModel) -> list[float]:
    """The cuts of the first storey, at most 65,535."""
    if model.top is not None:
        return model.top
    return model.cuts.where("tree = 1").first()["cuts"]


def kd_name(node: Column) -> Column:
    """``k`` and one bit for each level: the heap number without its leading 1."""
    return F.concat(F.lit("k"), F.substring(F.bin(node), 2, 64))


def _kd_regions(model: SpatialModel) -> DataFrame:
    """Boxes of the leaves; every edge follows from the cuts above a leaf, which its number names."""
    b, depth, top = model.bounds, model.shape["depth"], top_cuts(model)
    spark = model.cuts.sparkSession
    boxes = spark.range(2**depth, 2 ** (depth + 1)).withColumnRenamed("id", "node")
    edges = {"x0": [F.lit(float(b.min_x))], "y0": [F.lit(float(b.min_y))], "x1": [F.lit(float(b.max_x))], "y1": [F.lit(float(b.max_y))]}
    for start, levels in storeys(depth):
        if not levels:
            continue
        cuts = F.lit(None)
        if start:
            name = f"_cuts{start}"
            boxes = boxes.withColumn("tree", F.shiftright("node", depth - start))
            boxes = boxes.join(_storey(model, start).withColumnRenamed("cuts", name), "tree", "left").drop("tree")
            cuts = F.coalesce(name, F.array().cast("array<double>"))
        else:
            cuts = packed(top)
        for level in range(start, start + levels):
            place = F.expr(f"shiftright(node, {depth - level}) - shiftleft(shiftright(node, {depth - start}), {level - start}) + {2 ** (level - start) - 1}")
            cut = F.coalesce(F.get(cuts, place.cast("int")), F.lit(math.inf))
            right = F.expr(f"shiftright(node, {depth - level - 1}) % 2 = 1")
            axis = "xy"[level % 2]
            edges[f"{axis}0"].append(F.when(right, cut))
            edges[f"{axis}1"].append(F.when(~right, cut))
    box = {}
    for axis in "xy":
        high = F.least(*edges[f"{axis}1"]) if len(edges[f"{axis}1"]) > 1 else edges[f"{axis}1"][0]
        low = F.greatest(*edges[f"{axis}0"]) if len(edges[f"{axis}0"]) > 1 else edges[f"{axis}0"][0]
        box |= {f"{axis}0": F.least(low, high), f"{axis}1": high}
    return boxes.select(kd_name(F.col("node")).alias("loc"), "node", *(box[e].alias(e) for e in ("x0", "y0", "x1", "y1")))


def _keyed(sample: DataFrame) -> tuple[DataFrame, dict]:
    """The sample as a table of its own, in files of a good size, with sort keys; counts and ranges.

    Several passes follow; they must not read the full data and sample it each time.
    """
    rows = sample.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").hint("rebalance")
    keyed = rows.selectExpr("x", "y", f"{sort_key('x')} AS kx", f"{sort_key('y')} AS ky")
    ranges = [f(f"k{a}").alias(f"{name}_{a}") for a in "xy" for name, f in (("low", F.min), ("high", F.max))]
    return publish_with_facts(keyed, "sample", F.count(F.lit(1)).alias("n"), *ranges)


# ---- STR tiles --------------------------------------------------------------------


def build_strtree(sample: DataFrame, bounds: Bounds, capacity: int) -> SpatialModel:
    """Sort-tile-recursive packing: equal slabs by x, then equal tiles by y in each slab.

    The outer tiles have no outer edges, so every point has a tile. Cuts are exact, and a
    table ``tree, cuts`` with one row for each slab; row -1 holds those between slabs, as
    many as the root of the number of tiles.
    """
    require_positive(capacity=capacity)
    spark = sample.sparkSession
    sample, facts = _keyed(sample)
    n = facts["n"]
    side = max(1, math.ceil(math.sqrt(math.ceil(n / capacity))))
    x_cuts, rows_of_slab = [], n
    if side > 1:
        found = select_cuts(sample.selectExpr("0L AS node", "kx AS k", "x AS v"), side, n, n, facts["low_x"], facts["high_x"]).first()["cuts"]
        x_cuts, below = [c["v"] for c in found], [0, *(c["below"] for c in found), n]
        rows_of_slab = max(b - a for a, b in zip(below, below[1:], strict=False))
    top = spark.createDataFrame([(-1, x_cuts)], "tree long, cuts array<double>")
    model = SpatialModel("strtree", bounds, None, {"side": side}, top, x_cuts)
    slabs = spark.range(side).withColumnRenamed("id", "tree")
    if side > 1:
        rows = walk_slabs(sample, model).select(F.col("_slab").cast("long").alias("node"), F.col("ky").alias("k"), F.col("y").alias("v"))
        tiles = select_cuts(rows, side, n, rows_of_slab, facts["low_y"], facts["high_y"])
        tiles = tiles.select(F.col("node").alias("tree"), F.transform("cuts", lambda c: c["v"]).alias("cuts"))
        # a slab without sample points (equal cuts) is one open tile and side - 1 empty ones
        open_tiles = F.array_repeat(F.lit(math.inf), side - 1)
        slabs = slabs.join(tiles, "tree", "left").select("tree", F.coalesce("cuts", open_tiles).alias("cuts"))
    else:
        slabs = slabs.select("tree", F.array().cast("array<double>").alias("cuts"))
    model = replace(model, cuts=publish(top.unionByName(slabs), "strtree-cuts"))
    return replace(model, regions=publish(_str_regions(model), "strtree"))


def _str_regions(model: SpatialModel) -> DataFrame:
    """Boxes of all tiles; a slab's tiles are made from its own row."""
    side, xs = model.shape["side"], packed(model.top) if model.top else F.array().cast("array<double>")

    def edge(cuts: Column | str, position: Column, beyond: float) -> Column:
        return F.coalesce(F.get(cuts, position), F.lit(beyond))

    tiles = model.cuts.where("tree >= 0").select(F.col("tree").cast("int").alias("slab"), "cuts")
    tiles = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return tiles.select(
        str_name(F.col("slab"), F.col("tile")).alias("loc"),
        F.col("slab").cast("long").alias("slab"),
        "tile",
        edge(xs, F.col("slab") - 1, -math.inf).alias("x0"),
        edge("cuts", F.col("tile") - 1, -math.inf).alias("y0"),
        edge(xs, F.col("slab"), math.inf).alias("x1"),
        edge("cuts", F.col("tile"), math.inf).alias("y1"),
    )


def walk_slabs(points: DataFrame, model: SpatialModel) -> DataFrame:
    """Adds ``_slab``, by binary search in the cuts between slabs."""
    xs = model.top if model.top is not None else model.cuts.where("tree = -1").first()["cuts"]
    levels = len(xs).bit_length()
    walked = walk(points, "_slab", packed(xs), levels, in_order(levels), lambda _: F.col("x"))
    return walked.withColumn("_slab", F.least("_slab", F.lit(len(xs))))


def walk_tiles(points: DataFrame, model: SpatialModel) -> DataFrame:
    """Adds ``_slab`` and ``_tile``: binary search for the slab, then in the slab's own cuts.

    The cuts of all slabs are one array in the plan where they are few; otherwise points
    meet the row of their slab, which is broadcast up to a size and shuffled beyond it.
    """
    side = model.shape["side"]
    slabs = walk_slabs(points, model)
    levels = (side - 1).bit_length()
    width = 2**levels - 1
    value = lambda _: F.col("y")
    if side * width <= PACKED:
        rows = sorted(model.cuts.where("tree >= 0").collect(), key=lambda r: r["tree"])
        flat = [c for r in rows for c in [*r["cuts"], *[math.inf] * (width - side + 1)]]
        place = in_order(levels)
        found = walk(slabs, "_tile", packed(flat), levels, lambda level, path: F.col("_slab") * width + place(level, path), value)
    else:
        own = model.cuts.where("tree >= 0").select(F.col("tree").cast("int").alias("_slab"), F.col("cuts").alias("_cuts"))
        met = slabs.join(F.broadcast(own) if side * side * 8 <= BROADCAST_BYTES else own, "_slab", "left")
        found = walk(met, "_tile", F.col("_cuts"), levels, in_order(levels), value).drop("_cuts")
    return found.withColumn("_tile", F.least("_tile", F.lit(side - 1)))


def str_name(slab: Column, tile: Column) -> Column:
    return F.concat(F.lit("s"), slab.cast("string"), F.lit("_"), tile.cast("string"))


def tight_boxes(assigned: DataFrame) -> DataFrame:
    """Smallest closed box around the points of each region, as an R-tree keeps it."""
    return assigned.groupBy("loc").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )


# ---- searches ---------------------------------------------------------------------


def regions_for_circle(model: SpatialModel, x: float, y: float, r: float) -> DataFrame:
    """Regions that a circle touches."""
    return model.regions.where(circle_touches_region(float(x), float(y), float(r), model.bounds))


def regions_for_box(model: SpatialModel, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Regions that a rectangle touches."""
    return model.regions.where(box_touches_region(float(x0), float(y0), float(x1), float(y1), model.bounds))
