"""Circle and box range queries, single and as whole workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.predicates import in_box, in_circle, in_time
from geotrail.operators.candidates import SCALES, at_scales, candidate_join_keys, extent, is_circles, shape_columns
from geotrail.operators.dealing import MAX_TASKS, ROWS, WORK, dealt_join, measured_keys, sizes
from geotrail.operators.gather import MAX_POINTS, WHOLE, build_trajectories, number_in_order
from geotrail.operators.models import SpatialModel, model_regions, regions_for_box, regions_for_circle
from geotrail.operators.numbering import number_rows
from geotrail.operators.regroup import curve, grains, grouped_model, rows_by_level, with_groups
from geotrail.params import OUTSIDE, BoxQuery, CircleQuery
from geotrail.scratch import BROADCAST_ROWS, publish, publish_with_facts, setting

LISTED_REGIONS = 2_000
"""Most region names written into a filter; more are joined instead."""

TASK_WORK = 1 << 23
CUT_WORK = 1 << 19
"""Comparisons of one task, about, where trajectories are dealt to tasks: for hits, and for their places."""
FEW_REGIONS = 64
"""Regions of a model that need no groups."""
GROUP_ROWS = 16
"""Most rows that regions in groups may take in a shuffled join, for one row of one group, about."""
BITS = 62
MASKS = 16
"""Places in a trajectory that one number marks, and most such numbers of a row."""
PLACES = 6
PLACE_MASKS = 3
"""Most places that are read from marks one by one, and most such numbers to read them from."""
WORD = 64
"""Most trajectories that one number marks."""
CELL_WORK = 1 << 23
CELL_KEYS = 1 << 16
CELL_WORDS = 1 << 9
"""Comparisons, candidate rows and numbers of trajectories of one cell, about, where hits are marked."""
NAMES = 100_000
"""Names of trajectories that one task numbers, about."""


def _bounding_box(q: CircleQuery | BoxQuery) -> tuple[float, float, float, float]:
    if isinstance(q, CircleQuery):
        return q.x - q.r, q.y - q.r, q.x + q.r, q.y + q.r
    return q.x0, q.y0, q.x1, q.y1


def refine(points: DataFrame, q: CircleQuery | BoxQuery) -> DataFrame:
    """Points inside the query. The bounding ranges come first: the scan can use them."""
    box = (float(v) for v in _bounding_box(q))
    hits = points.where(in_time("t", q.ta, q.tb) & in_box("x", "y", *box))
    if isinstance(q, CircleQuery):
        hits = hits.where(in_circle("x", "y", float(q.x), float(q.y), float(q.r)))
    return hits


def _truncated(t: int, window: int) -> int:
    return t // window if t >= 0 else -(-t // window)


def candidates_of(points: DataFrame, model: SpatialModel, window: int, q: CircleQuery | BoxQuery) -> DataFrame:
    """Points of the partitions that a query touches.

    Region names and the block range become literals, which prune files and row groups
    of a stored table before the job starts. Names come from the model only.
    """
    if isinstance(q, CircleQuery):
        touched = regions_for_circle(model, q.x, q.y, q.r)
    else:
        touched = regions_for_box(model, q.x0, q.y0, q.x1, q.y1)
    touched = touched.select("loc")
    in_blocks = F.col("block").between(_truncated(q.ta, window), _truncated(q.tb, window))
    near = points.where(in_blocks)
    b, box = model.bounds, _bounding_box(q)
    beyond = box[0] < b.min_x or box[1] < b.min_y or box[2] >= b.max_x or box[3] >= b.max_y
    names = [row["loc"] for row in touched.limit(LISTED_REGIONS + 1).collect()]
    if len(names) <= LISTED_REGIONS:
        return near.where(F.col("loc").isin(names + [OUTSIDE] * beyond))
    if beyond:
        touched = touched.unionByName(touched.sparkSession.range(1).select(F.lit(OUTSIDE).alias("loc")))
    return near.join(touched, "loc", "left_semi")


def query_points(points: DataFrame, model: SpatialModel, window: int, q: CircleQuery | BoxQuery) -> DataFrame:
    """Hits of one query as points, with ``query_id``; ``points`` is keyed by loc, block.

    The exact test comes first: numbers are cheaper to compare than region names, which
    then only serve to skip files and row groups.
    """
    hits = candidates_of(refine(points, q), model, window, q)
    return hits.withColumn("query_id", F.lit(q.query_id).cast("bigint"))


def scan_points(points: DataFrame, q: CircleQuery | BoxQuery) -> DataFrame:
    """Hits of one query by testing every point: the truth for the pruned form."""
    return refine(points, q).withColumn("query_id", F.lit(q.query_id).cast("bigint"))


def circle_query(
    points: DataFrame,
    model: SpatialModel,
    window: int,
    q: CircleQuery,
    max_points: int = MAX_POINTS,
    longest: int | None = None,
) -> DataFrame:
    """Trajectories cut down to a circle and an interval; empty table if there are none."""
    return build_trajectories(query_points(points, model, window, q), max_points, longest)


def box_query(
    points: DataFrame,
    model: SpatialModel,
    window: int,
    q: BoxQuery,
    max_points: int = MAX_POINTS,
    longest: int | None = None,
) -> DataFrame:
    """Trajectories cut down to a rectangle and an interval."""
    return build_trajectories(query_points(points, model, window, q), max_points, longest)


# ---- workloads --------------------------------------------------------------------


def _inside(workload: DataFrame) -> Column:
    shape = ["_q" + c for c in shape_columns(workload)]
    in_shape = in_circle if is_circles(workload) else in_box
    return in_time("t", "_qta", "_qtb") & in_shape("x", "y", *shape)


def workload_points(
    points: DataFrame,
    workload: DataFrame,
    model: SpatialModel,
    window: int,
    counts: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    split_points: int = ROWS,
    work: int = WORK,
    marked: bool = False,
) -> DataFrame:
    """Hits of a whole workload in one job: the columns of ``points`` and ``query_id``.

    Points meet queries by an equi join on their partition. A workload that fits
    ``broadcast_rows`` at some coarseness is broadcast, its regions in groups, and points are
    dealt by trajectory to as many tasks as there is work: all hits of a trajectory come out of
    one task, and putting them together moves none of them. Otherwise, and where one trajectory
    has more comparisons than ``work``, the candidate table, of groups too, is broadcast up to
    ``broadcast_rows`` and both sides are shuffled beyond that. Partitions whose
    points times queries are more than ``work``, or, where points are shuffled, with more
    than ``split_points`` rows of a side, are joined as grids instead, spread over many
    tasks. They are found in ``counts``, the partition counts of a store, or by counting the
    points of the partitions that many queries ask for.

    With ``marked``, hits get a cell ``_cell`` that one task holds, all hits of a query in a
    trajectory in the same, and the trajectory as bit ``_bit`` of number ``_word``: what
    ``query_result_counts`` needs to count without moving hits. Not so where one trajectory has
    too many comparisons for a task.
    """
    if marked:
        hits = _marked_points(points, workload, model, window, broadcast_rows, work)
        if hits is not None:
            return hits
    longest = _longest_trajectory(points)
    return _workload_points(points, workload, model, window, counts, longest, broadcast_rows, split_points, work)


def _longest_trajectory(points: DataFrame) -> int:
    return sizes(points, ["traj_id"], "_n").agg(F.max("_n")).first()[0] or 0


def _workload_points(points, workload, model, window, counts, longest, broadcast_rows=BROADCAST_ROWS, split_points=ROWS, work=WORK, deal=True) -> DataFrame:
    dealt = _dealt_sides(points, workload, model, window, longest, TASK_WORK, broadcast_rows, work) if deal else None
    if dealt is not None:
        near, numbers, keys, scales, tasks = dealt
        own = [F.col("_loc").alias("loc") if c == "loc" and "_loc" in near.columns else F.col(c) for c in points.columns]
        at, on = at_scales(near.repartition(tasks, "traj_id"), scales)
        met = at.join(F.broadcast(numbers), on).join(F.broadcast(keys), "_k")
        return met.where(_inside(workload)).select("query_id", *own)
    columns = points.columns
    placed, grouped, counts = _in_groups(points, workload, model, window, counts, broadcast_rows)
    keys, facts = _published_keys(workload, grouped, window)
    if not facts["n"]:
        return points.where("false").select(F.lit(0).cast("bigint").alias("query_id"), *columns)
    scales, keys, near = _sides(placed, workload, keys, facts)
    near, on = at_scales(near, scales)
    small = facts["n"] <= broadcast_rows
    heavy, n_heavy, cells, pairs = _heavy_partitions(placed, keys, on, scales, counts, work, None if small else split_points)
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, min(int(max(pairs / TASK_WORK, facts["n"] / ROWS)) + 1, MAX_TASKS))
    own = [F.col("_loc").alias("loc") if c == "loc" and "_loc" in near.columns else F.col(c) for c in columns]

    def hits(met: DataFrame) -> DataFrame:
        return met.where(_inside(workload)).select("query_id", *own)

    def plain(keys: DataFrame) -> DataFrame:
        if small:
            return (near.repartition(tasks) if pairs > TASK_WORK else near).join(F.broadcast(keys), on)
        # few bytes of file can be very many keys: never broadcast by the size of the file
        return near.repartition(tasks, *on).join(keys.repartition(tasks, *on).hint("shuffle_hash"), on)

    if not n_heavy:
        return hits(plain(keys))
    known = heavy.select(*on)
    known = F.broadcast(known) if n_heavy <= BROADCAST_ROWS else known
    others = hits(plain(keys.join(known, on, "left_anti")))
    # several cells of little work share a task
    cells = min(cells, int(pairs / TASK_WORK) + 1)
    return others.unionByName(hits(dealt_join(near, keys, on, heavy, n_heavy, cells)))


def _in_groups(points: DataFrame, workload: DataFrame, model: SpatialModel, window: int, counts: DataFrame | None, broadcast_rows: int) -> tuple[DataFrame, SpatialModel, DataFrame | None]:
    """Points, model and partition counts with regions in groups, for a join by partition.

    The groups are the finest with which the workload can be broadcast or, where that is finer, has
    ``GROUP_ROWS`` times the rows that it has with one group.
    """
    n_regions = model_regions(model)
    if n_regions <= FEW_REGIONS:
        return points, model, counts
    by_level = rows_by_level(workload, model.bounds, window)
    level = max(k for k, n in enumerate(by_level) if n <= max(broadcast_rows, GROUP_ROWS * by_level[0]))
    grouped, groups = grouped_model(model, level)
    few = n_regions <= BROADCAST_ROWS
    return with_groups(points, groups, few), grouped, None if counts is None else with_groups(counts, groups, few)


def _published_keys(workload: DataFrame, model: SpatialModel, window: int, coarser: int = 0) -> tuple[DataFrame, dict]:
    """The candidate table and its bounds."""
    x0, y0, x1, y1 = extent(workload)
    return publish_with_facts(
        candidate_join_keys(workload, model, window, coarser).select("query_id", "loc", "scale", "block", *shape_columns(workload), "ta", "tb"),
        "candidates",
        F.count(F.lit(1)).alias("n"),
        *(F.expr(f"count_if(scale = {s})").alias(f"scale{s}") for s in range(SCALES)),
        F.min("ta").alias("ta"),
        F.max("tb").alias("tb"),
        F.expr(f"min({x0})").alias("x0"),
        F.expr(f"min({y0})").alias("y0"),
        F.expr(f"max({x1})").alias("x1"),
        F.expr(f"max({y1})").alias("y1"),
    )


def _sides(points: DataFrame, workload: DataFrame, keys: DataFrame, facts: dict) -> tuple[list[int], DataFrame, DataFrame]:
    """The time scales in use, the keys, and the points that are near, to be taken at these scales."""
    scales = [s for s in range(SCALES) if facts[f"scale{s}"]]
    carried = [*shape_columns(workload), "ta", "tb"]
    keys = keys.selectExpr("query_id", "loc", "scale", "block AS _block", *(f"{c} AS _q{c}" for c in carried)).where(
        "_qta <= _qtb"
    )
    near = points.where(
        in_time("t", facts["ta"], facts["tb"]) & in_box("x", "y", facts["x0"], facts["y0"], facts["x1"], facts["y1"])
    )
    if scales == [0]:
        keys = keys.drop("scale").withColumnRenamed("_block", "block")
    return scales, keys, near


def _dealt_sides(
    points: DataFrame, workload: DataFrame, model: SpatialModel, window: int, longest: int, task_work: int, broadcast_rows: int = BROADCAST_ROWS, work: int = WORK
) -> tuple[DataFrame, DataFrame, DataFrame, list[int], int] | None:
    """Both sides of a join with the workload broadcast and points dealt by trajectory; None where that does not fit.

    Regions are put into groups of about the size of a cell of one level, and blocks made coarser
    where the workload is large: of what has few rows, that with the fewest comparisons. The tasks
    follow from the comparisons, which are counted. Partitions get a number, by which the
    keys are joined: a join by one number is the fastest, and keys of a partition lie side by side.
    """
    fitting = [(volume, rows, coarser, level) for coarser, level, rows, volume in grains(workload, model.bounds, window) if rows <= broadcast_rows]
    if not fitting:
        return None
    *_, coarser, level = min(fitting)
    n_regions = model_regions(model)
    # regions may be crowded where queries are, and overhang their cell: checked on the table itself
    for cells in [None] * (n_regions <= FEW_REGIONS) + [k for k in (level, level - 1, level - 2) if k >= 0]:
        grouped, placed = model, points
        if cells is not None:
            grouped, groups = grouped_model(model, cells)
            placed = with_groups(points, groups, n_regions <= BROADCAST_ROWS)
        keys, facts = _published_keys(workload, grouped, window, coarser)
        if facts["n"] <= broadcast_rows:
            break
    if not facts["n"] or facts["n"] > broadcast_rows:
        return None
    scales, keys, near = _sides(placed, workload, keys, facts)
    at, on = at_scales(near.select("loc", "block"), scales)
    numbered = sizes(keys, on, "_r").withColumn("_k", F.monotonically_increasing_id())
    asked, facts = publish_with_facts(numbered, "asked", F.max("_r").alias("most"))
    if longest * (facts["most"] or 0) > work:
        return None
    met = sizes(at, on, "_l").join(F.broadcast(asked), on).agg(F.expr("sum(double(_l) * _r)")).first()[0] or 0
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, min(int(met / task_work) + 1, MAX_TASKS))
    # the comparison lets Spark prune partitions of a store by them at run time
    numbers = asked.where("_r > 0").drop("_r")
    keys = keys.join(F.broadcast(numbers), on).drop(*on).repartitionByRange("_k").sortWithinPartitions("_k")
    return near, numbers, publish(keys, "keys"), scales, tasks


def _marked_points(points: DataFrame, workload: DataFrame, model: SpatialModel, window: int, broadcast_rows: int, work: int) -> DataFrame | None:
    """Hits with their cell and the mark of their trajectory, see ``workload_points``; None where that does not fit.

    Queries that are near each other on a curve are a row of cells, trajectories are dealt to the
    columns. A point is copied to the rows that ask for its region, a query and the list of its
    partitions to every column; both meet by partition inside the cell.
    """
    columns = points.columns
    placed, grouped, _ = _in_groups(points, workload, model, window, None, broadcast_rows)
    keys, facts = _published_keys(workload, grouped, window)
    if not facts["n"]:
        return None
    scales, keys, near = _sides(placed, workload, keys, facts)
    at, on = at_scales(near.select("loc", "block"), scales)
    shape = [f"_q{c}" for c in [*shape_columns(workload), "ta", "tb"]]
    lists = [F.collect_list(F.struct(*on)).alias("_keys"), F.sum("_l").alias("_met")]
    counted = [F.sum(F.size("_keys")).alias("keys"), F.sum(F.col("_met").cast("double")).alias("met")]
    # partitions without points are left out
    parts = max(points.sparkSession.sparkContext.defaultParallelism, min(facts["n"] // CELL_KEYS + 1, MAX_TASKS))
    met = keys.join(sizes(at, on, "_l"), on).repartition(parts, "query_id").groupBy("query_id", *shape).agg(*lists)
    middle = ("_qx", "_qy") if is_circles(workload) else ("(_qx0 + _qx1) / 2", "(_qy0 + _qy1) / 2")
    met = met.withColumn("_z", F.expr(curve(*middle, "query_id", model.bounds)))
    asked, facts = publish_with_facts(met, "asked", *counted, F.max("_met").alias("most"))
    if not facts["keys"]:
        return None
    names, known = _numbered_trajectories(near)
    rows = int(facts["keys"] / CELL_KEYS) + 1
    asked = _in_rows(asked, rows)
    ends = asked.select("_g", F.explode("_keys").alias("_k")).select("_g", "_k.*")
    asking = sizes(ends, ["_g", *on], "_r").agg(F.max("_r")).first()[0]
    if known["most"] * asking > work:
        return None
    word = max(1, min(WORD, work // max(known["most"] * asking, 1)))
    words = known["n"] // word + 1
    tasks = points.sparkSession.sparkContext.defaultParallelism
    cells = max(int(facts["met"] / CELL_WORK) + 1, words * rows // CELL_WORDS, tasks)
    across = max(1, min(-(-cells // rows), words, MAX_TASKS // rows))
    tasks = min(rows * across, MAX_TASKS)

    routes, found = publish_with_facts(ends.select("loc", "_g").distinct(), "routes", F.count(F.lit(1)).alias("n"))
    routes = F.broadcast(routes) if found["n"] <= BROADCAST_ROWS else routes
    names = F.broadcast(names) if known["n"] <= BROADCAST_ROWS else names
    own = [c for c in near.columns if c != "traj_id"]
    # points of no trajectory are in no word, and spread
    marks = {"_word": f"_no div {word}", "_bit": f"int(_no % {word})", "_h": f"pmod(coalesce(_no div {word}, xxhash64(t, x, y)), {across}L)"}
    cell = F.expr(f"_g * {across}L + _h").alias("_cell")
    left = near.join(names, "traj_id", "left").selectExpr("traj_id", *own, *(f"{v} AS {k}" for k, v in marks.items()))
    left = left.join(routes, "loc").select("traj_id", *own, "_word", "_bit", cell)
    left, on = at_scales(left.repartition(tasks, "_cell"), scales)
    # one word after another, and the queries of a partition side by side: both stay in the cache
    left = left.sortWithinPartitions("_cell", "_word", *on)
    copied = asked.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select("query_id", *shape, "_keys", cell)
    right = copied.repartition(tasks, "_cell").select("_cell", "query_id", *shape, F.explode("_keys").alias("_k")).select("*", "_k.*").drop("_k")
    right = right.sortWithinPartitions("_cell", *on)
    hits = left.join(right.hint("shuffle_hash"), ["_cell", *on]).where(_inside(workload))
    own = [F.col("_loc").alias("loc") if c == "loc" and "_loc" in near.columns else F.col(c) for c in columns]
    return hits.select("query_id", *own, "_cell", "_word", "_bit")


def _numbered_trajectories(points: DataFrame) -> tuple[DataFrame, dict]:
    """``traj_id`` and its number ``_no``; how many there are, and the points of the longest."""
    counted, facts = publish_with_facts(
        sizes(points.where("traj_id IS NOT NULL"), ["traj_id"], "_n"), "trajectories", F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")
    )
    bucket = F.expr(f"pmod(xxhash64(traj_id), {facts['n'] // NAMES + 1})")
    return number_rows(counted, bucket, ["traj_id"], "_no").selectExpr("traj_id", "_no - 1 AS _no"), facts


def _in_rows(asked: DataFrame, rows: int) -> DataFrame:
    """Adds ``_g``: runs of about as many queries in the order of ``_z``, numbered.

    Queries of one id are where the first of them is.
    """
    if rows == 1:
        return asked.withColumn("_g", F.lit(0))
    placed = asked
    if (sizes(asked.where("query_id IS NOT NULL"), ["query_id"], "_n").agg(F.max("_n")).first()[0] or 0) > 1:
        first = F.min("_z").over(Window.partitionBy("query_id"))
        placed = placed.withColumn("_z", F.when(F.col("query_id").isNull(), F.col("_z")).otherwise(first))
    shares = F.array(*(F.lit(k / rows) for k in range(1, rows)))
    cuts = placed.agg(F.percentile_approx("_z", shares, max(10_000, 20 * rows))).first()[0]
    listed = ", ".join(f"{c}L" for c in sorted(set(cuts)))
    return placed.withColumn("_g", F.expr(f"size(filter(array({listed}), c -> c < _z))")).drop("_z")


def _heavy_partitions(
    points: DataFrame, keys: DataFrame, on: list[str], scales: list[int], counts: DataFrame | None, work: int, rows: int | None
) -> tuple[DataFrame | None, int, int, float]:
    """Partitions to be joined as grids, and the comparisons of all that are counted; nothing is counted that cannot be one."""
    asked = sizes(keys, on, "_r")
    total = counts.agg(F.sum("n_points")).first()[0] if counts is not None else points.count()
    most = asked.agg(F.max("_r")).first()[0] if total else 0
    if not total or (most * total <= work and (not rows or max(total, most) <= rows)):
        return None, 0, 0, 0.0
    if counts is None:
        wanted = asked if rows else asked.where(F.col("_r") * total > work)
        at, _ = at_scales(points.select("loc", "block"), scales)
        held = sizes(at.join(wanted.select(*on), on, "left_semi"), on, "_l")
    else:
        at, _ = at_scales(counts, scales)
        held = at.groupBy(*on).agg(F.sum("n_points").alias("_l"))
    return measured_keys(held, asked, on, work, rows)


def _workload_trajectories(points, workload, model, window, max_points, longest, counts) -> DataFrame:
    """Hits of a trajectory are no more than its points for each query of an id: a bound that saves counting hits."""
    facts = sizes(points, ["traj_id"], "_n").agg(F.max("_n").alias("most"), F.expr("count_if(traj_id IS NULL)").alias("unnamed")).first()
    most = facts["most"] or 0
    repeats = sizes(workload, ["query_id"], "_n").agg(F.max("_n")).first()[0] or 0
    marks = repeats == 1 and not facts["unnamed"] and most <= min(max_points, MASKS * BITS)
    if marks:
        dealt = _dealt_sides(points, workload, model, window, most, CUT_WORK)
        if dealt is not None:
            cut = _cut_trajectories(*dealt, _inside(workload), -(-most // BITS))
            WHOLE[cut] = ["query_id", "traj_id"]
            return cut
    hits = _workload_points(points, workload, model, window, counts, most, deal=not marks)
    if longest is None:
        longest = most * repeats if most * repeats <= max_points else None
    return build_trajectories(hits, max_points, longest)


def _cut_trajectories(near: DataFrame, numbers: DataFrame, keys: DataFrame, scales: list[int], tasks: int, inside: Column, masks: int) -> DataFrame:
    """``query_id, traj_id, part, points`` without a list for each query: hits are kept as places in the trajectory.

    A trajectory's points are put in order once. A query's hits in it become their number, the
    first and the last place, and bits of all places: numbers, aggregated where lists would have
    to be sorted. The points come back from the ordered trajectory, in the same task.
    """
    held = F.array_sort(F.collect_list(F.struct("t", "x", "y", "loc", "block")))
    ordered = near.select("traj_id", "t", "x", "y", "loc", "block").repartition(tasks, "traj_id").groupBy("traj_id").agg(held.alias("_held"))
    placed = ordered.select("traj_id", F.posexplode("_held").alias("_at", "_p"))
    bits = [f"CASE WHEN _at div {BITS} = {k} THEN shiftleft(1L, _at % {BITS}) ELSE 0L END AS _m{k}" for k in range(masks)]
    at, on = at_scales(placed.selectExpr("traj_id", "_at", "_p.*", *bits), scales)
    marked = (
        at.join(F.broadcast(numbers), on)
        .join(F.broadcast(keys), "_k")
        .where(inside)
        .groupBy("query_id", "traj_id")
        .agg(F.count(F.lit(1)).cast("int").alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"), *(F.bit_or(f"_m{k}").alias(f"_m{k}") for k in range(masks)))
    )
    whole = ordered.select("traj_id", F.transform("_held", lambda p: F.struct(p["t"].alias("t"), p["x"].alias("x"), p["y"].alias("y"))).alias("_all"))
    met = _with_points(marked.join(whole.hint("shuffle_hash"), "traj_id"), masks)
    return met.select("query_id", "traj_id", F.lit(0).cast("bigint").alias("part"), "points")


def _with_points(met: DataFrame, masks: int) -> DataFrame:
    """Adds ``points``, those of ``_all`` at the ``_n`` places from ``_first`` to ``_last`` that are marked in ``_m0``, ``_m1``, ...

    Few places are read from the marks one by one, in generated code; a function over the whole
    trajectory is not generated, and is left to the rows with more places, which alone carry it there.
    """
    places, few = ["_first"], PLACES if masks <= PLACE_MASKS else 2
    met = met.selectExpr("*", *(f"_m{k} AS _s{k}" for k in range(masks)))
    for j in range(1, few - 1):
        # without the lowest mark; the lowest of those left
        left = [" AND ".join([*(f"_s{i} = 0" for i in range(k)), "TRUE"]) for k in range(masks)]
        less = [f"CASE WHEN {left[k]} THEN _s{k} & (_s{k} - 1) ELSE _s{k} END AS _s{k}" for k in range(masks)]
        met = met.selectExpr(*(c for c in met.columns if not c.startswith("_s")), *less)
        lowest = " ".join(f"WHEN _s{k} != 0 THEN {k * BITS} + bit_count((_s{k} & -_s{k}) - 1)" for k in range(masks))
        met = met.selectExpr("*", f"CASE {lowest} END AS _p{j}")
        places.append(f"_p{j}")
    taken = " ".join(f"WHEN {n} THEN array({', '.join(f'_all[{p}]' for p in ['_first', *places[1 : n - 1], *['_last'][: n - 1]])})" for n in range(1, few + 1))
    run, mask = "_n = _last - _first + 1", " ".join(f"WHEN {k} THEN _m{k}" for k in range(masks))
    points = f"CASE WHEN _n > {few} AND {run} THEN slice(_all, _first + 1, _n) ELSE CASE _n {taken} END END AS points"
    met = met.selectExpr("query_id", "traj_id", *(f"_m{k}" for k in range(masks)), points, f"CASE WHEN _n > {few} AND NOT {run} THEN _all END AS _rest")
    marked = f"filter(_rest, (p, i) -> shiftright(CASE i div {BITS} {mask} END, i % {BITS}) & 1L = 1L)"
    return met.selectExpr("query_id", "traj_id", f"CASE WHEN _rest IS NULL THEN points ELSE {marked} END AS points")


def circle_workload(points, workload, model, window, max_points=MAX_POINTS, longest=None, counts=None) -> DataFrame:
    """Trajectories of every circle of a workload; ``counts`` are the partition counts of a store."""
    return _workload_trajectories(points, workload, model, window, max_points, longest, counts)


def box_workload(points, workload, model, window, max_points=MAX_POINTS, longest=None, counts=None) -> DataFrame:
    """Trajectories of every box of a workload; ``counts`` are the partition counts of a store."""
    return _workload_trajectories(points, workload, model, window, max_points, longest, counts)


def query_result_counts(workload: DataFrame, hits: DataFrame) -> DataFrame:
    """Trajectories and points found by each query; 0 for a query without hits.

    Marked hits, see ``workload_points``, are counted at once, in the task of their cell: the join's
    sides lie by cell, which Spark is told to accept while the counts are written.
    """
    if "_word" in hits.columns:
        seen = F.expr("bit_or(shiftleft(1L, _bit))").alias("_seen")
        words = hits.groupBy("_cell", "query_id", "_word").agg(seen, F.count("*").alias("_n"))
        found = words.groupBy("query_id").agg(F.sum(F.bit_count("_seen")).alias("n_trajectories"), F.sum("_n").alias("n_points"))
        with setting(hits.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            found = publish(found, "result-counts")
    else:
        found = hits.groupBy("query_id").agg(
            F.countDistinct("traj_id").alias("n_trajectories"), F.count("*").alias("n_points")
        )
    return (
        workload.select("query_id")
        .join(found, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("n_trajectories", F.lit(0)).alias("n_trajectories"),
            F.coalesce("n_points", F.lit(0)).alias("n_points"),
        )
    )


def number_queries(workload: DataFrame) -> DataFrame:
    """Adds ``query_no``, 1 for the query issued first; ties by ``query_id``."""
    return number_in_order(workload, ["issued_ms", "query_id"], "query_no")
