"""Operator 4, approximate nearest neighbours: a small-world graph for each shard.

Equal vectors are one node, so a vector that a third of all rows share does not fill its
neighbourhood with copies. Nodes go to the cell of their nearest centre, and every cell is cut
by hash into shards of about ``shard_rows``; the centres are fitted on a bounded sample, every
node is indexed. A shard's graph has layers, each with a share of the nodes below it; a node's
neighbours in a layer are the closest ones that are not closer to a neighbour already chosen,
and links go both ways. A layer is a flat array of ``degree`` neighbours per node. Searches start
in the top layer and keep the ``width`` best nodes on the way in the bottom layer; many queries
walk at once. The shards' results are merged by exact inner product in double precision.

The inner product is turned into a distance by one more coordinate that gives all vectors
of a shard the same length.

A query first visits the shards of its best cell. What it finds there is a lower bound of its
last result, so it then visits those cells alone whose upper bound, from centre, radius and
longest vector, is no smaller: a cell that is passed over holds no result. Only the queries
that visit a shard are sent to it, and its index is copied once for every ``block`` of them,
so what is shuffled follows the visits.

Defined results: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components take no part; equal scores are ordered by id; a query is
never its own result; repeated ids count as one row if their vectors are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.scratch import publish, publish_with_facts

SHARD_ROWS = 8_192
DEGREE = 32
WIDTH = 96
BLOCK = 2_048
"""Queries of a shard that one copy of its index answers, about."""
CELLS = 1_024
"""Most cells; larger tables have several shards in a cell."""
SAMPLE, SAMPLE_OF_CELL = 8_192, 64
"""Distinct vectors on which the centres are fitted, about: the larger of these, the second for each cell."""
ROUNDS = 12
LAYER_SHARE = 16
UPPER_WIDTH = 32
NEAREST = 96
"""Closest nodes among which a node's neighbours are chosen."""


def _closest(points: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` closest other points of each point, nearest first."""
    n, out = len(points), []
    square = (points**2).sum(1)
    for at in range(0, n, 512):
        distance = square[None, :] - 2 * (points[at : at + 512] @ points.T)
        distance[np.arange(len(distance)), at + np.arange(len(distance))] = np.inf
        near = np.argpartition(distance, min(count, n - 1) - 1, axis=1)[:, :count]
        order = np.argsort(np.take_along_axis(distance, near, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(near, order, 1))
    return np.concatenate(out)


def link_layer(points: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of each point (rows of ``degree``, -1 where there is none)."""
    n = len(points)
    links = np.full((n, degree), -1, np.int32)
    if n < 2:
        return links
    near = _closest(points, min(NEAREST, n - 1))
    half, chosen = degree // 2, np.zeros(near.shape, bool)
    for at in range(0, n, 256):
        own, who = points[at : at + 256], near[at : at + 256]
        around = points[who]
        to_self = ((around - own[:, None]) ** 2).sum(2)
        square = (around**2).sum(2)
        between = square[:, :, None] + square[:, None, :] - 2 * around @ around.transpose(0, 2, 1)
        picked = np.zeros(who.shape, bool)
        for c in range(who.shape[1]):
            covered = (picked & (between[:, c] < to_self[:, c, None])).any(1)
            picked[:, c] = ~covered & (picked.sum(1) < half)
        chosen[at : at + 256] = picked
    rows, places = np.nonzero(chosen)
    ends = near[rows, places]
    a, b = np.concatenate([rows, ends]), np.concatenate([ends, rows])
    passed_over = np.nonzero(~chosen)
    a, b = np.concatenate([a, passed_over[0]]), np.concatenate([b, near[passed_over]])
    # links chosen by either end come first, then free places go to the closest others
    late = np.repeat([0, 1], [2 * len(rows), len(passed_over[0])])
    distance = ((points[a] - points[b]) ** 2).sum(1)
    order = np.lexsort((distance, late, a))
    a, b = a[order], b[order]
    _, once = np.unique(a.astype(np.int64) * n + b, return_index=True)
    once.sort()
    a, b = a[once], b[once]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    fits = place < degree
    links[a[fits], place[fits]] = b[fits]
    return links


def build_graph(vectors: np.ndarray, degree: int = DEGREE, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top: (nodes of the layer, their neighbours as places in the layer)."""
    points = lifted(vectors)
    order = np.random.default_rng(seed).permutation(len(points))
    layers, size = [], len(points)
    while True:
        nodes = np.sort(order[:size])
        layers.append((nodes.astype(np.int32), link_layer(points[nodes], degree)))
        if size <= 2 * degree:
            break
        size = max(1, size // LAYER_SHARE)
    return layers[::-1]


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate that makes all of them equally long."""
    square = (vectors.astype(np.float64) ** 2).sum(1)
    rest = np.sqrt(np.maximum(square.max(initial=0) - square, 0))
    return np.column_stack([vectors, rest]).astype(np.float32)


def walk(queries: np.ndarray, vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` best nodes found for each query (-1 where fewer), best first."""
    rows, degree = np.arange(len(queries)), links.shape[1]
    best = np.full((len(queries), width), -1, np.int64)
    score = np.full((len(queries), width), -np.inf, np.float32)
    open_ = np.zeros((len(queries), width), bool)
    seen = np.zeros((len(queries), len(vectors) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    k = min(entry.shape[1], width)
    best[:, :k], open_[:, :k] = entry[:, :k], entry[:, :k] >= 0
    score[:, :k] = np.einsum("qd,qkd->qk", queries, vectors[entry[:, :k]])
    score[~open_] = -np.inf
    seen[rows[:, None], best] = True
    active = rows
    while len(active):
        pick = np.where(open_[active], score[active], -np.inf).argmax(1)
        going = open_[active, pick]
        active, pick = active[going], pick[going]
        if not len(active):
            break
        open_[active, pick] = False
        around = links[best[active, pick]].astype(np.int64)
        new = ~seen[active[:, None], around]
        seen[active[:, None], around] = True
        gained = np.einsum("qd,qkd->qk", queries[active], vectors[around])
        gained[~new] = -np.inf
        all_score = np.concatenate([score[active], gained], 1)
        all_best = np.concatenate([best[active], np.where(new, around, -1)], 1)
        all_open = np.concatenate([open_[active], new], 1)
        top = np.argpartition(-all_score, width - 1, axis=1)[:, :width] if degree else np.arange(width)[None]
        score[active] = np.take_along_axis(all_score, top, 1)
        best[active] = np.take_along_axis(all_best, top, 1)
        open_[active] = np.take_along_axis(all_open, top, 1) & (score[active] > -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(best, order, 1)


def search_graph(queries: np.ndarray, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Best nodes of the bottom layer for each query."""
    entry = np.tile(np.arange(min(width, len(layers[0][0]))), (len(queries), 1))
    for level, (nodes, links) in enumerate(layers):
        last = level + 1 == len(layers)
        found = walk(queries, vectors[nodes], links, entry, width if last else min(UPPER_WIDTH, len(nodes)))
        if last:
            return found
        below = layers[level + 1][0]
        names = nodes[np.maximum(found, 0)]
        entry = np.where(found >= 0, np.searchsorted(below, names), -1)
    raise AssertionError("a graph has at least one layer")


@dataclass(frozen=True)
class Cells:
    """Centres, and of each cell the largest distance from its centre, the longest vector and the number of shards."""

    centres: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    shards: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.shards) - self.shards

    def bounds(self, asks: np.ndarray) -> np.ndarray:
        """No inner product of a query with a vector of a cell is larger."""
        length = np.sqrt((asks**2).sum(1))[:, None]
        ball = asks @ self.centres.T + length * self.radius
        bound = np.minimum(ball, length * self.longest)
        return bound + 1e-9 * (1 + np.abs(bound))

    def shards_of(self, cells: np.ndarray) -> np.ndarray:
        first = self.first
        return np.concatenate([np.arange(first[c], first[c] + self.shards[c]) for c in cells]) if len(cells) else np.zeros(0, np.int64)

    def best(self, asks: np.ndarray) -> np.ndarray:
        """The cell that a query visits first."""
        return np.where(self.shards > 0, asks @ self.centres.T, -np.inf).argmax(1)


def fit_centres(points: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Centres of ``count`` cells by a few rounds of k-means."""
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.permutation(len(points))[:count])].copy()
    for _ in range(ROUNDS):
        cell, _ = nearest_centre(points, centres)
        held = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, points)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
        # an empty cell starts anew inside the fullest one
        for empty in np.flatnonzero(held == 0):
            centres[empty] = points[rng.choice(np.flatnonzero(cell == held.argmax()))]
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each point and its distance from the centre."""
    cell = np.empty(len(points), np.int64)
    square = (centres**2).sum(1)
    for at in range(0, len(points), 4096):
        cell[at : at + 4096] = (square - 2 * points[at : at + 4096] @ centres.T).argmin(1)
    return cell, np.sqrt(((points - centres[cell]) ** 2).sum(1))


def _table(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list())


def _make_cells(nodes: DataFrame, total: int, dim: int, shard_rows: int) -> tuple[Cells, Column]:
    """The cells of all nodes, and the shard of a node as a column."""
    count = min(CELLS, -(-total // shard_rows))
    if count == 1:
        centres = np.zeros((1, dim))
    else:
        share = -(-total // max(SAMPLE, SAMPLE_OF_CELL * count))
        sample = nodes.where(F.pmod(F.xxhash64("h1", "h2", F.lit(7)), F.lit(share)) == 0).select("h1", "h2", "v")

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            points = _table(part.sort_values(["h1", "h2"])["v"])
            return pd.DataFrame({"centres": [_bytes(fit_centres(points, min(count, len(points))))]})

        fitted = sample.groupBy().applyInPandas(fit, "centres binary").first()
        centres = np.frombuffer(fitted["centres"]).reshape(-1, dim) if fitted else np.zeros((1, dim))

    @F.pandas_udf("cell int, distance double, length double")
    def place(v: pd.Series) -> pd.DataFrame:
        points = _table(v)
        cell, distance = nearest_centre(points, centres)
        return pd.DataFrame({"cell": cell.astype(np.int32), "distance": distance, "length": np.sqrt((points**2).sum(1))})

    placed = nodes.select(place("v").alias("at")).groupBy("at.cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("at.distance").alias("radius"), F.max("at.length").alias("longest")
    )
    facts = {r["cell"]: r for r in placed.collect()}  # at most CELLS rows
    column = lambda name: np.array([facts[c][name] if c in facts else 0 for c in range(len(centres))])
    cells = Cells(centres, column("radius"), column("longest"), -(-column("n") // shard_rows))
    first, shards = cells.first, cells.shards

    @F.pandas_udf("long")
    def shard(v: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
        cell, _ = nearest_centre(_table(v), centres)
        dealt = (h1.to_numpy().astype(np.uint64) ^ (h2.to_numpy().astype(np.uint64) >> np.uint64(7))) % np.maximum(shards[cell], 1).astype(np.uint64)
        return pd.Series(first[cell] + dealt.astype(np.int64))

    return cells, shard("v", "h1", "h2")


def _bytes(table: np.ndarray) -> bytes:
    return np.ascontiguousarray(table).tobytes()


def usable(vector: Column) -> Column:
    """Whether all components are there and finite, and one is not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    width: int = WIDTH,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row that ``queries`` selects."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("_asks", F.coalesce(queries, F.lit(False)))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col("_asks").alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dim["dim"]
    rows = rows.where(F.size("v") == dim).select("vec_id", "asks", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1))})
    rows = publish(rows.groupBy("h1", "h2", "vec_id").agg(F.first("v").alias("v"), F.max("asks").alias("asks")), "vectors")
    # the smallest ids of each vector, found in salted groups first
    salted = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.select("h1", "h2", "vec_id").withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1)
    few = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max("asks").alias("asks")).join(few, ["h1", "h2"])
    nodes, facts = publish_with_facts(nodes, "nodes", F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("asking"))
    cells, shard_of = _make_cells(nodes, facts["n"], dim, shard_rows)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h1", "h2"])
        table = np.stack(part["v"].to_list())
        layers = build_graph(table, degree)
        ids = [np.asarray(x, np.int64) for x in part["ids"]]
        return pd.DataFrame(
            {
                "shard": [part["shard"].iloc[0]],
                "vectors": [_bytes(table)],
                "ids": [_bytes(np.concatenate(ids))],
                "held": [_bytes(np.array([len(x) for x in ids], np.int64))],
                "nodes": [[_bytes(n) for n, _ in layers]],
                "links": [[_bytes(x) for _, x in layers]],
            }
        )

    index = nodes.withColumn("shard", shard_of).groupBy("shard").applyInPandas(
        build, "shard long, vectors binary, ids binary, held binary, nodes array<binary>, links array<binary>"
    )
    index = publish(index, "index")
    asked = nodes.where("asks").select("h1", "h2", "v")

    def search(questions: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(shard):
            return pd.DataFrame({"h1": [], "h2": [], "ids": [], "scores": []})
        shard = shard.iloc[0]
        table = np.frombuffer(shard["vectors"]).reshape(-1, dim)
        layers = [
            (np.frombuffer(n, np.int32), np.frombuffer(x, np.int32).reshape(-1, degree))
            for n, x in zip(shard["nodes"], shard["links"], strict=True)
        ]
        held = np.frombuffer(shard["held"], np.int64)
        ids, pointers = np.frombuffer(shard["ids"], np.int64), np.concatenate([[0], np.cumsum(held)])
        asks = np.stack(questions["v"].to_list())
        found = search_graph(asks.astype(np.float32), table.astype(np.float32), layers, max(width, k + 1))
        out_ids, out_scores = [], []
        for q, best in enumerate(found):
            best = best[best >= 0]
            exact = table[best] @ asks[q]
            owner = np.repeat(exact, held[best])
            names = np.concatenate([ids[pointers[b] : pointers[b + 1]] for b in best]) if len(best) else ids[:0]
            order = np.lexsort((names, -owner))[: k + 1]
            out_ids.append(names[order])
            out_scores.append(owner[order])
        return pd.DataFrame({"h1": questions["h1"], "h2": questions["h2"], "ids": out_ids, "scores": out_scores})

    def ask(visits: DataFrame) -> DataFrame:
        """What queries (h1, h2, v, shard) find in the shards they visit: h1, h2, vec_id, score."""
        copies = F.ceil(F.count(F.lit(1)) / block).alias("copies")
        per_shard = publish(visits.groupBy("shard").agg(copies), "visits")
        dealt = visits.join(per_shard, "shard").withColumn("copy", F.pmod(F.xxhash64("h1", "h2", F.lit(6)), F.col("copies")))
        held = index.join(per_shard, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        found = dealt.select("h1", "h2", "v", "shard", "copy").groupBy("shard", "copy").cogroup(held.drop("copies").groupBy("shard", "copy"))
        found = found.applyInPandas(search, "h1 long, h2 long, ids array<long>, scores array<double>")
        found = found.select("h1", "h2", F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
        return found.select("h1", "h2", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))

    def ranked(hits: DataFrame) -> DataFrame:
        merged = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("n", F.row_number().over(merged)).where(F.col("n") <= k + 1)

    @F.pandas_udf("array<long>")
    def first_shards(v: pd.Series) -> pd.Series:
        return pd.Series([cells.shards_of([c]) for c in cells.best(_table(v))])

    @F.pandas_udf("array<long>")
    def other_shards(v: pd.Series, least: pd.Series) -> pd.Series:
        asks = _table(v)
        open_ = (cells.bounds(asks) >= least.to_numpy()[:, None]) & (cells.shards > 0)
        open_[np.arange(len(asks)), cells.best(asks)] = False
        return pd.Series([cells.shards_of(np.flatnonzero(row)) for row in open_])

    best = publish(ranked(ask(asked.withColumn("shard", F.explode(first_shards("v"))))), "hits")
    if np.count_nonzero(cells.shards) > 1:
        least = best.where(F.col("n") == k + 1).select("h1", "h2", F.col("score").alias("least"))
        least = asked.join(least, ["h1", "h2"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        more = ask(least.select("h1", "h2", "v", F.explode(other_shards("v", "least")).alias("shard")))
        best = ranked(best.drop("n").unionByName(more))
    lists = best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    mine = rows.where("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").join(lists, ["h1", "h2"])
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
