"""Equi joins whose work is spread, not only their rows.

A task of a hash join compares all rows that share a key, left times right. Where that is too
much for one task, the key becomes a grid: the left rows are dealt to ``a`` rows of it, the
right rows to ``b`` columns, and every left row meets every right row in exactly one of the
a x b cells. A row is copied only along its own row or column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.scratch import BROADCAST_ROWS, publish_with_facts

WORK = 1 << 30
"""Comparisons of one task, about."""
ROWS = 1_000_000
"""Most rows of one side that a cell of a shuffled join holds, about."""
TASK_PAIRS = 1 << 22
"""Pairs that one task of a shuffled join puts out, about."""
MAX_TASKS = 10_000


def heavy_keys(left: DataFrame, right: DataFrame, on: Sequence[str], work: int = WORK, rows: int | None = ROWS) -> tuple[DataFrame, int, int]:
    """Keys that one task should not join alone, with their grid ``_a, _b``; how many, and their cells.

    ``left`` and ``right`` have a row for each key and its number of rows, ``_l`` and ``_r``.
    Square cells cost the fewest copies: the shorter side is cut only when both are longer
    than the root of ``work``. ``rows`` also bounds each side of a cell. Cells beyond ``MAX_TASKS``
    would be joined by the same tasks, with more copies: ``work`` is at least the share of one of them.
    """
    return measured_keys(left, right, on, work, rows)[:3]


def measured_keys(left: DataFrame, right: DataFrame, on: Sequence[str], work: int, rows: int | None) -> tuple[DataFrame, int, int, float]:
    """``heavy_keys``, and the comparisons of all keys."""
    table, facts = publish_with_facts(left.join(right, list(on)).select(*on, "_l", "_r"), "joined-keys", F.expr("sum(double(_l) * _r)").alias("pairs"))
    pairs = facts["pairs"] or 0.0
    work = max(work, int(pairs / MAX_TASKS))
    side = int(work**0.5)
    bounds = [f"_l > {rows} OR _r > {rows}"] if rows else []
    over = " OR ".join([f"double(_l) * _r > {float(work)!r}D", *bounds])
    a, b = f"ceil(_l / greatest({side}D, {float(work)!r}D / _r))", f"ceil(_r / greatest({side}D, {float(work)!r}D / _l))"
    if rows:
        a, b = f"greatest({a}, ceil(_l / {rows}))", f"greatest({b}, ceil(_r / {rows}))"
    heavy = table.where(over).selectExpr(*on, f"int({a}) AS _a", f"int({b}) AS _b")
    found = heavy.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(CAST(_a AS BIGINT) * _b)").alias("cells")).first()
    return heavy, found["n"], found["cells"] or 0, pairs


def dealt_join(left: DataFrame, right: DataFrame, on: Sequence[str], heavy: DataFrame, n_heavy: int, cells: int) -> DataFrame:
    """The join of the rows under heavy keys, in grids.

    Rows are dealt by their place in their scan: that separates copies too, and a repeated
    task reads the same rows in the same order. Cells are shuffled to a set number of tasks,
    which is not lowered for being few bytes.
    """
    on, heavy = list(on), F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy
    cell = [*on, "_p", "_q"]
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(cells, MAX_TASKS))

    def dealt(side: DataFrame, own: str, count: str, other: str, copies: str) -> DataFrame:
        placed = side.withColumn("_row", F.monotonically_increasing_id()).join(heavy, on)
        cut = placed.withColumn(own, F.expr(f"int(_row % {count})")).withColumn(other, F.expr(f"explode(sequence(0, {copies} - 1))"))
        return cut.drop("_row", "_a", "_b").repartition(tasks, *cell)

    met = dealt(left, "_p", "_a", "_q", "_b").join(dealt(right, "_q", "_b", "_p", "_a").hint("shuffle_hash"), cell)
    return met.drop("_p", "_q")


def sizes(rows: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Rows under each key, as column ``name``."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias(name))


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], work: int = WORK, rows: int = ROWS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """An inner join by shuffle in which no task has much more than ``work`` comparisons.

    Both sides are read twice: counted by key, and joined. Few bytes can be very many pairs, so
    the tasks follow from the pairs, ``task_pairs`` each, and are not lowered for being few bytes.
    Few pairs can come of very many rows, whose number the size of a file does not tell: both sides
    are always dealt, so that a side is broadcast only once its true size is known.
    """
    on = list(on)
    heavy, n, cells, pairs = measured_keys(sizes(left, on, "_l"), sizes(right, on, "_r"), on, work, rows)
    tasks = min(int(pairs / task_pairs) + 1, MAX_TASKS)

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        dealt = (tasks, *on) if tasks > 1 else tuple(on)
        return a.repartition(*dealt).join(b.repartition(*dealt), on)

    if not n:
        return joined(left, right)
    known = F.broadcast(heavy.select(*on)) if n <= BROADCAST_ROWS else heavy.select(*on)
    light = joined(left.join(known, on, "left_anti"), right.join(known, on, "left_anti"))
    return light.unionByName(dealt_join(left, right, on, heavy, n, cells))
