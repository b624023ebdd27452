"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.scratch import publish_with_facts

ROUNDS = 50


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); the root is the smallest node.

    Each round links the larger neighbours of a node to its smallest one, then the smaller
    ones; it ends when the table stays the same. Every round is written to the shared
    folder, so nothing is computed twice and a lost executor costs one round at most.
    """
    state = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")]
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, before = publish_with_facts(pairs, "edges", *state)
    for _ in range(ROUNDS):
        if not before["n"]:
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # here a > b in every row: the neighbours of a that are smaller
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.unionByName(low.withColumnRenamed("m", "b")).where("a <> b").distinct()
        pairs, after = publish_with_facts(now, "edges", *state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
