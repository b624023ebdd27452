"""Operator 3, n-gram Jaccard join by chosen paths.

A document is the set of its shingles of ``k`` words (all words, if it has fewer). Documents
with equal sets form one class, and only one set of each class goes on. In every run all
sets start in one bucket and are split on a sampled shared token: the shingle that comes
first in a random order, which two sets have in common with a probability equal to their
similarity. Buckets that are still too large are split again, up to ``depth`` times; small
buckets are compared by brute force, exactly. A pair of the threshold survives ``d`` splits
with probability ``threshold**d``; runs are repeated until that gives the target recall:
``runs_for(1)`` runs for all sets, ``runs_for(depth)`` for those that met a large bucket.

Large groups of near copies stay together whatever is split. They are dealt to blocks, and
pairs of blocks are compared; a task gives the link counts of its sets and a forest of
links, never all pairs. A pair that shares buckets of several runs counts in the first one.

Defined results: one row for every row of the input; texts without a word, and null ones,
have class_id = doc_id and no link; repeated rows are copies of each other; a null id stays
a row of its own with class_id null; rows that share an id but not a text share a class.
Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrail.llm.components import components
from geotrail.llm.docfilter import document_filter, may_matter
from geotrail.llm.encoding import column_of
from geotrail.llm.textbuf import find_words, gram_hashes, inside_rows, mix, rows_of, span_hashes, text_slices
from geotrail.scratch import publish, publish_with_facts

K = 5
THRESHOLD = 0.8
RECALL = 0.9999
DEPTH = 2
SMALL = 64
"""Sets in a bucket that is compared at once."""
UNIT_SHINGLES = 2_000_000
"""Shingles in a unit of work, about; blocks of larger buckets are cut to half of it."""
BLOCK = 1024
COLUMNS = 4096

SETS = "doc_id {id}, n_shingles long, sig1 long, sig2 long, tokens array<long>"


def runs_for(depth: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair of the threshold was compared with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted within each row, and row pointers."""
    starts, ends, pointers = find_words(data, offsets)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, k)
    ok = inside_rows(pointers, k, len(grams))
    row, grams = (rows_of(pointers)[: len(grams)][ok], grams[ok]) if len(grams) else (np.zeros(0, np.int64), grams)
    few = np.flatnonzero((np.diff(pointers) < k) & (np.diff(pointers) > 0))
    whole = [mix(gram_hashes(words[pointers[r] : pointers[r + 1]], int(pointers[r + 1] - pointers[r]))) for r in few]
    if whole:
        row, grams = np.concatenate([row, few]), np.concatenate([grams, *whole])
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    row, grams = row[new], grams[new]
    return grams, np.searchsorted(row, np.arange(len(offsets)))


def _orders(count: int) -> np.ndarray:
    """Random odd factors, one for each order of the shingles."""
    return np.random.default_rng(20_240_601).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _describe(rows: DataFrame, k: int, orders: int) -> DataFrame:
    """Set signature and first tokens of every document."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    factors = _orders(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column_of(batch, "doc_id")
            for row, data, offsets in text_slices(column_of(batch, "text")):
                grams, pointers = shingle_sets(data, offsets, k)
                full = np.flatnonzero(np.diff(pointers))
                n = len(offsets) - 1
                signs, tokens = np.zeros((2, n), np.uint64), np.zeros((n, orders), np.uint64)
                if len(full):
                    at = pointers[full]
                    signs[0, full] = np.add.reduceat(grams, at)
                    signs[1, full] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    for c, factor in enumerate(factors):
                        tokens[full, c] = np.minimum.reduceat(mix_order(grams, factor), at)
                lists = pa.ListArray.from_arrays(np.arange(0, n * orders + 1, orders, dtype=np.int32), tokens.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), pa.array(np.diff(pointers)), pa.array(signs[0].view(np.int64)), pa.array(signs[1].view(np.int64)), lists],
                    names=["doc_id", "n_shingles", "sig1", "sig2", "tokens"],
                )

    return rows.mapInArrow(run, SETS.format(id=kind))


def mix_order(grams: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Places of shingles in one random order."""
    h = grams * factor
    return (h ^ (h >> np.uint64(29))) * factor


def _split(rows: DataFrame, small: int) -> DataFrame:
    """Bucket of each (set, run): key replaced by the members' fingerprint, with size and shingles; lone sets go."""
    facts = rows.groupBy("run", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_shingles").alias("total"),
        F.xxhash64(F.sum(F.xxhash64("set_id").cast("decimal(38,0)")), F.count(F.lit(1))).alias("bucket"),
    )
    return rows.join(facts.where("n > 1"), ["run", "key"]).withColumn(
        "large", (F.col("n") > small) | (F.col("total") > UNIT_SHINGLES)
    )


def _buckets(sets: DataFrame, threshold: float, recall: float, depth: int, small: int) -> DataFrame:
    """Final buckets (set_id, run, bucket, n, total) of all runs."""
    first, more = runs_for(1, threshold, recall), runs_for(depth, threshold, recall)
    width = more * depth

    def enter(some: DataFrame, runs: range) -> DataFrame:
        start = F.slice("tokens", runs.start + 1, len(runs))
        exploded = some.select("set_id", "n_shingles", F.posexplode(start).alias("run", "key"))
        return exploded.withColumn("run", F.col("run") + runs.start)

    done = []
    current = enter(sets, range(first))
    seen_large = None
    for stage in range(2):
        for level in range(1, depth + 1):
            found, facts = publish_with_facts(
                _split(current, small), "buckets", F.coalesce(F.sum(F.col("large").cast("long")), F.lit(0)).alias("large")
            )
            done.append(found.where("NOT large") if level < depth else found)
            if level == depth or not facts["large"]:
                break
            if stage == 0 and level == 1:
                seen_large = found.where("large").select("set_id").distinct()
            # the next token of this run; runs and levels never share an order
            token = F.element_at("tokens", (F.col("run") + 1 + more * level).cast("int"))
            again = found.where("large").select("set_id", "run", F.col("key").alias("path"))
            current = again.join(sets, "set_id").select("set_id", "n_shingles", "run", F.xxhash64("path", token).alias("key"))
        if seen_large is None or first == more:
            break
        current = enter(sets.join(seen_large, "set_id", "left_semi"), range(first, more))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    assert width <= orders_needed(threshold, recall, depth)
    return out.select("set_id", "run", "bucket", "n", "total")


def orders_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    return runs_for(depth, threshold, recall) * depth


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, exactly."""
    out = np.zeros((len(left), len(right)), np.float32)
    if len(left) * len(right) <= 16:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                out[i, j] = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
        return out
    owner = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    every = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(every[0], every[1])
    for at in range(0, len(shared), COLUMNS):
        columns = shared[at : at + COLUMNS]
        tables = []
        for rows, side, whose in zip((len(left), len(right)), every, owner, strict=True):
            place = np.minimum(np.searchsorted(columns, side), len(columns) - 1)
            hit = columns[place] == side
            table = np.zeros((rows, len(columns)), np.float32)
            table[whose[hit], place[hit]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _compare(part: pd.DataFrame, threshold: float) -> tuple[list, list]:
    """Link counts and a forest of links of one unit: a bucket, or two blocks of one."""
    i, j = part["i"].iloc[0], part["j"].iloc[0]
    part = part.sort_values("set_id", kind="stable").drop_duplicates("set_id")
    sides = [part[part["block"] == i], part[part["block"] == j]] if i != j else [part, part]
    if not len(sides[0]) or not len(sides[1]):
        return [], []
    sets = [[np.asarray(s).view(np.uint64) for s in side["shingles"]] for side in sides]
    sizes = [np.array([len(s) for s in group], float) for group in sets]
    both = overlaps(*sets)
    alike = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-9
    if i == j:
        np.fill_diagonal(alike, False)
    bucket = part["bucket"].iloc[0]
    trails = [np.array(side["trail"].tolist()) for side in sides]
    for a in np.flatnonzero(alike.any(1)):  # the first bucket that both were in is to be this one
        b = np.flatnonzero(alike[a])
        common = (trails[0][a] == trails[1][b]) & (trails[0][a] != 0)
        alike[a, b] = trails[0][a][common.argmax(1)] == bucket
    names = [side["set_id"].tolist() for side in sides]
    weights = [side["n_docs"].to_numpy() for side in sides]
    counts = list(zip(names[0], (alike @ weights[1]).tolist(), strict=True))
    if i != j:
        counts += list(zip(names[1], (alike.T @ weights[0]).tolist(), strict=True))
    return [(s, n) for s, n in counts if n], _forest(alike, names)


def _forest(alike: np.ndarray, names: list[list]) -> list[tuple]:
    """Links that connect what all links connect, at most one less than there are sets."""
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(alike), strict=True):
        x, y = top(names[0][a]), top(names[1][b])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((names[0][a], names[1][b]))
    return out


def join_similar(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    k: int = K,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    depth: int = DEPTH,
    small: int = SMALL,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, class_id (smallest id that links lead to), n_links (other documents that are similar), n_copies."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    described = publish(_describe(rows, k, orders_needed(threshold, recall, depth)), "described")
    with_words = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = with_words.groupBy("sig1", "sig2", "n_shingles").agg(
        F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("n_docs"), F.first("tokens").alias("tokens")
    )
    sets = publish(classes, "sets")
    buckets = _buckets(sets.select("set_id", "n_shingles", "tokens"), threshold, recall, depth, small)
    own = buckets.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("run", "bucket", "n", "total"))).alias("own"))
    members = publish(own.join(sets.select("set_id", "n_docs", "sig1", "n_shingles"), "set_id"), "members")

    # shingles are taken from the texts on their way to the units, so they are moved once
    runs = runs_for(depth, threshold, recall)
    in_run = F.map_from_entries(F.transform("own", lambda o: F.struct(o["run"], o["bucket"])))
    trail = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.try_element_at(in_run, r), F.lit(0)))
    homes = members.select("set_id", F.col("own")[0]["bucket"].alias("home"), F.inline(F.array_distinct(F.transform("own", lambda o: o.dropFields("run")))))
    units = _units(homes, small, block).groupBy("set_id").agg(F.collect_list(F.struct("bucket", "block", "i", "j")).alias("units"))
    trails = units.join(members, "set_id").select("set_id", "n_docs", "sig1", "n_shingles", trail.alias("trail"), "units")
    shingles = F.coalesce(F.sum(F.col("n_shingles") * F.size("units")), F.lit(0)).alias("total")
    trails, facts = publish_with_facts(trails, "trails", shingles)
    bins = 1 + facts["total"] // UNIT_SHINGLES
    near = may_matter(rows, document_filter(trails.select(F.col("set_id").alias("doc_id"))))
    wanted = near.join(trails, F.col("doc_id") == F.col("set_id")).select("set_id", "n_docs", "trail", "units", "sig1", "text")
    work = _with_shingles(wanted.distinct(), k).select("set_id", "n_docs", "trail", "shingles", F.inline("units"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        counts, links = [], []
        for _, unit in part.groupby(["bucket", "i", "j"], sort=True):
            c, e = _compare(unit, threshold)
            counts += c
            links += e
        return pd.DataFrame(
            {"a": [s for s, _ in counts] + [a for a, _ in links], "b": [None] * len(counts) + [b for _, b in links], "n": [n for _, n in counts] + [0] * len(links)}
        )

    work = work.withColumn("bin", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(bins)))
    found = publish(work.groupBy("bin").applyInPandas(compare, f"a {kind}, b {kind}, n long"), "links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("links"))

    of_set = sets.select("sig1", "sig2", "n_shingles", "set_id", "n_docs").join(links, "set_id", "left")
    of_set = of_set.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    answers = with_words.select("doc_id", "sig1", "sig2", "n_shingles").join(of_set, ["sig1", "sig2", "n_shingles"])
    answers = answers.select(
        "doc_id",
        F.coalesce("root", "set_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
        (F.col("n_docs") - 1).alias("n_copies"),
    )
    alone = described.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies")
    )
    return answers.unionByName(alone)


def _units(crowds: DataFrame, small: int, block: int) -> DataFrame:
    """Units of work (set_id, bucket, block, i, j): a set goes to every pair of blocks it is in.

    ``crowds`` has every bucket of a set once, with ``home``, the first bucket of the set.
    Buckets of later runs mostly hold what one bucket held before, and pairs of that were
    compared there. A bucket of such sets alone is passed over; in a large one only the
    blocks of the other members meet all blocks. A small bucket is one block.
    """
    homes = crowds.groupBy("bucket", "home").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"), F.max("total").alias("total"))
    done = F.when(F.col("home") != F.col("bucket"), F.col("m")).otherwise(0)
    plan = homes.groupBy("bucket").agg(
        F.max(F.struct(done.alias("m"), "home")).alias("most"), F.max("n").alias("n"), F.max("total").alias("total")
    )
    large = (F.col("n") > small) | (F.col("total") > UNIT_SHINGLES)
    cuts = lambda n: F.ceil(n * F.greatest(F.lit(1 / block), F.col("total") * 2 / UNIT_SHINGLES / F.col("n")))
    plan = plan.where(F.col("most.m") < F.col("n")).select(
        "bucket",
        F.when(large & (F.col("most.m") > 0), F.col("most.home")).alias("known"),
        F.when(large, cuts(F.col("n") - F.col("most.m"))).otherwise(1).alias("new_blocks"),
        F.when(large, cuts(F.col("most.m"))).otherwise(0).alias("old_blocks"),
    )
    rows = crowds.select("set_id", "bucket", "home").join(plan, "bucket")
    old = F.coalesce(F.col("home") == F.col("known"), F.lit(False))
    dealt = F.xxhash64("set_id", F.lit(3))
    rows = rows.withColumn("block", F.when(old, F.col("new_blocks") + F.pmod(dealt, F.col("old_blocks"))).otherwise(F.pmod(dealt, F.col("new_blocks"))))
    last = F.when(old, F.col("new_blocks")).otherwise(F.col("new_blocks") + F.col("old_blocks")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pairs = rows.select("set_id", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return pairs


def _with_shingles(rows: DataFrame, k: int) -> DataFrame:
    """The shingle sets of some documents, in place of text and signature."""
    kept = rows.drop("sig1", "text")
    names = kept.columns
    shingles = T.StructField("shingles", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(column_of(batch, "text")):
                grams, pointers = shingle_sets(data, offsets, k)
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pointers.astype(np.int32), np.ascontiguousarray(grams).view(np.int64))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(grams)])
                same = (sums[pointers[1:]] - sums[pointers[:-1]]).view(np.int64) == column_of(batch, "sig1").slice(row, n).to_numpy()
                columns = [column_of(batch, c).slice(row, n) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=[*names, "shingles"]).filter(pa.array(same))

    return rows.mapInArrow(run, T.StructType([*kept.schema.fields, shingles]))
