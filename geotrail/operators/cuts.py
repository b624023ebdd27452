"""Exact cuts of many groups at once, and the walk of points through cuts.

Selection is by radix. A double becomes a long that sorts the same way; the leading bits of
the longs are counted for each group, map side, running totals say which prefixes hold a
wanted rank, and only those are opened in the next pass. The passes depend on the 64 bits of
a number, not on how many rows there are, and no row is moved before its prefix is known to
hold a cut. A value that a third of all rows share is one counter.

A walk goes down an implicit binary tree whose cuts lie in one array: the place of a node
follows from the path to it, so a level is a subscript and a comparison in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.scratch import BROADCAST_ROWS, publish_with_facts

LEADING_BITS = 13
"""Bits of a prefix that one pass counts, about."""
OPENED = 250_000
"""Rows of a prefix that are sorted; a prefix with more is opened further, unless it is one value."""
PACKED = 1 << 16
"""Most cuts that are written into a plan as one array; more are a table of arrays."""
STRIDE = 3
"""Levels of a walk between two places where the path is kept as computed."""


def sort_key(v: str) -> str:
    """SQL text: a long that orders like the double ``v``; -0.0 is 0.0, and NaN comes last.

    Exponent and fraction by arithmetic that is exact for doubles. There are no branches, so
    that generated code computes each part once.
    """
    least, most = "2.2250738585072014E-308D", "1.7976931348623157E308D"
    size = f"least(greatest(abs({v}), {least}), {most})"
    near = f"greatest(floor(log2({size})), -1022L)"
    rough = f"({size} / power(2D, {near}))"
    power = f"({near} + bigint({rough} >= 2) - bigint({rough} < 1))"
    normal = f"shiftleft({power} + 1023L, 52) + bigint(({size} / power(2D, {power}) - 1) * 4503599627370496D)"
    # below the least normal number doubles are whole multiples of 2 to the power -1074; from there on this adds nothing
    tiny = f"bigint(least(abs({v}), {least}) * power(2D, 537) * power(2D, 537)) - 4503599627370496L"
    beyond = f"bigint(abs({v}) > {most}) + bigint(isnan({v}))"
    return f"(({normal}) + ({tiny}) + ({beyond})) * (1L - 2L * bigint({v} < 0))"


def _hits(upto: str, c: str, n: str, parts: int) -> str:
    """SQL text: array of the cuts i of 1 to parts - 1 whose rank, ceil(i / parts * n), is one of the last ``c`` of ``upto``."""
    first = f"greatest(1L, bigint(floor(({upto} - {c}) / double({n}) * {parts})))"
    last = f"least({parts - 1}L, bigint(ceil({upto} / double({n}) * {parts})) + 1L)"
    rank = f"bigint(ceil(double(i) / {parts}D * {n}))"
    some = f"filter(sequence({first}, {last}), i -> {rank} > {upto} - {c} AND {rank} <= {upto})"
    return f"CASE WHEN {first} <= {last} THEN {some} END"


def select_cuts(rows: DataFrame, parts: int, n: int, largest: int, low: int, high: int) -> DataFrame:
    """Exact cuts of every group: ``node, n, cuts``, cuts an array of structs ``i, v, below``.

    ``rows`` has ``node`` (long), ``k`` and ``v``: a double and its sort key, between ``low``
    and ``high``. Cut i of 1 to ``parts`` - 1 is the value of rank ceil(i / parts * n);
    ``below`` is the number of smaller rows. There are ``n`` rows, and ``largest`` bounds
    those of a group: small groups are sorted at once.
    """
    if largest <= OPENED:
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // OPENED))
        own = Window.partitionBy("node").orderBy("k")
        every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranked = rows.repartition(tasks, "node").select(
            "node",
            "v",
            F.row_number().over(own).cast("long").alias("upto"),
            (F.rank().over(own) - 1).cast("long").alias("below"),
            F.count(F.lit(1)).over(every).alias("n"),
        )
        if parts == 2:  # one row of each group: there is nothing to collect
            middle = ranked.where(F.col("upto") == F.ceil(F.lit(0.5) * F.col("n")))
            return middle.select("node", "n", F.array(F.struct(F.lit(1).alias("i"), "v", "below")).alias("cuts"))
        found = ranked.select("node", "n", "v", "below", F.expr(f"explode({_hits('upto', '1L', 'n', parts)}) AS i"))
    else:
        opened = _open_prefixes(rows, parts, low, high)
        counted = opened.groupBy("node", "n", "start", "before", "k").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v"))
        run = Window.partitionBy("node", "start").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counted.withColumn("upto", F.col("before") + F.sum("c").over(run))
        found = ranked.selectExpr("node", "n", "v", "upto - c AS below", f"explode({_hits('upto', 'c', 'n', parts)}) AS i")
    return found.groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), "v", "below"))).alias("cuts"))


def _open_prefixes(rows: DataFrame, parts: int, low: int, high: int) -> DataFrame:
    """The rows whose prefix holds a cut: ``node, k, v, start, before, n``.

    ``start`` names a prefix of a node by its least key, ``before`` counts the node's rows
    ahead of it.
    """
    width = max(0, (high - low).bit_length() - LEADING_BITS)
    opened = rows.select("node", "k", "v", F.lit(low).alias("start"), F.lit(width).alias("width"))
    known = None
    while True:
        keyed = opened.withColumn("prefix", F.expr("shiftright(k, width) - shiftright(start, width)"))
        counts = keyed.groupBy("node", "start", "prefix").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("least"), F.max("k").alias("most"))
        own = Window.partitionBy("node", "start")
        run = own.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        if known is None:
            counts = counts.withColumns({"n": F.sum("c").over(own), "upto": F.sum("c").over(run)})
        else:
            counts = counts.join(known, ["node", "start"]).withColumn("upto", F.col("before") + F.sum("c").over(run)).drop("before")
        held = counts.selectExpr(
            "node", "start", "prefix", "least", "n", "upto - c AS before", f"greatest(0, length(bin(most - least)) - {LEADING_BITS}) AS wider", "c", "most"
        ).where(F.size(F.expr(_hits("(before + c)", "c", "n", parts))) > 0)
        crowded = F.max(F.when(F.col("least") < F.col("most"), F.col("c"))).alias("crowded")
        held, facts = publish_with_facts(held, "prefixes", crowded, F.count(F.lit(1)).alias("rows"))
        chosen = held.select("node", "start", "prefix", "least", "before", "n", "wider")
        met = keyed.join(F.broadcast(chosen) if facts["rows"] <= BROADCAST_ROWS else chosen, ["node", "start", "prefix"])
        opened = met.select("node", "k", "v", F.col("least").alias("start"), "before", "n", F.col("wider").alias("width"))
        if (facts["crowded"] or 0) <= OPENED:
            return opened
        opened = opened.select("node", "k", "v", "start", "width")
        known = held.select("node", F.col("least").alias("start"), "before", "n")


# ---- walks ------------------------------------------------------------------------


def packed(cuts: list[float]) -> Column:
    """Numbers as one array that the optimizer folds to a constant."""
    return F.split(F.lit(",".join("Infinity" if c == float("inf") else repr(float(c)) for c in cuts)), ",").cast("array<double>")


def _kept(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Sets column ``name``, and keeps it computed once.

    A chain of projections that use their predecessor twice is copied into every filter
    above it, twice for each link. Filters on the output of ``explode`` stay above it, and
    the explode of one element is a plain loop of generated code.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, value.alias("_next")).select(*others, F.explode(F.array("_next")).alias(name))


def walk(points: DataFrame, name: str, cuts: Column, levels: int, place: Callable[[int, Column], Column], value: Callable[[int], Column]) -> DataFrame:
    """Adds ``name``: the path through ``levels`` cuts as a number, one bit a level, 1 for right.

    ``place`` says where the cut of a level and the path so far is in the array ``cuts``,
    ``value`` which number is compared. A value equal to the cut goes right; a null, or a
    cut beyond the array, goes left.
    """
    walked, path = points.withColumn(name, F.lit(0)), F.col(name)
    for level in range(levels):
        right = value(level) >= F.get(cuts, place(level, path))
        path = path * 2 + F.when(right, 1).otherwise(0)
        if level % STRIDE == STRIDE - 1 or level == levels - 1:
            walked, path = _kept(walked, name, path), F.col(name)
    return walked


def in_heap(level: int, path: Column) -> Column:
    """Place of a cut where the levels of a tree follow each other."""
    return path + (2**level - 1)


def in_order(levels: int) -> Callable[[int, Column], Column]:
    """Place of a cut where all cuts are sorted: the walk is a binary search."""
    return lambda level, path: path * 2 ** (levels - level) + (2 ** (levels - level - 1) - 1)
