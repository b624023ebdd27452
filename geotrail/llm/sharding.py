"""Operator 11, sharding by histogram sort, in DataFrame functions only.

Rows are ordered by a key: a digest of the text, then the id, then a digest of the other
columns, so equal texts lie next to each other. One pass over the documents writes keys and
sizes, without texts. On that narrow table, passes count the exact bytes and rows below
evenly spaced candidate boundaries; only the stretch of keys that holds a wanted boundary is
probed again, more finely, until every splitter is as near to its target as the tolerance
asks, or no key lies between. Then the documents are exchanged once, straight to their
places, and sorted there.

A shard is cut into parts of about ``part_bytes``, so a task never holds a shard, and a text
that a third of all rows repeat is spread by its ids. What the driver sees are counts: at
most ``PROBES`` of a pass, or 16 for each open stretch if that is more.

The law is ``bytes``: the boundary before shard s is the one between two rows nearest to
s / shards of all bytes, the earlier one if two are as near, or, with a tolerance, one that
close. Shards so differ by less than two rows. A size is the UTF-8 bytes of the text and 1.

Defined results: a null text has no bytes; a null id sorts first; an empty table gives an
empty table; rows equal in every column cannot be told apart, go to one shard and are
numbered there in any order; with fewer rows than shards some shards are empty. Columns of
the input are kept, but for those named like an added one, which are replaced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotrail.scratch import publish_with_facts

PART_BYTES = 64 << 20
MAX_PARTS = 16_384
"""Parts of all shards together; beyond it parts grow, and are sorted on disk."""
PROBES = 16_384
PART_TOLERANCE = 0.02
"""How far, in parts, a boundary inside a shard may be off."""
LAW = "bytes"
ADDED = ["size", "law", "shard", "slot", "grown_shard"]
KEYS = ["k0", "k1", "k2"]
LEAST = -(2**63)
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


@dataclass(frozen=True)
class Splitter:
    """The first key on the right side of a boundary, and what lies to its left."""

    key: tuple[int, int, int]
    bytes: int
    rows: int


@dataclass
class Stretch:
    """Keys that share ``fixed``, with the targets that fall inside."""

    fixed: tuple[int, ...]
    low: int
    high: int
    targets: list[int]

    def shift(self, probes: int) -> int:
        """Bits that one candidate boundary is apart from the next, as a power of two."""
        return max(0, (self.high - self.low).bit_length() - (probes.bit_length() - 1))


def row_key(docs: DataFrame, text: str, key: str) -> list[Column]:
    """The sort key as three longs: digest of the text, the id, digest of what else there is."""
    integral = dict(docs.dtypes)[key] in INTEGRAL
    own = F.col(key).cast("long") if integral else F.xxhash64(F.col(key))
    rest = [F.to_json(F.struct(c)) if kind.startswith("map") else F.col(c) for c, kind in docs.dtypes if c not in (text, key)]
    content = F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 15), 16, 10).cast("long")
    return [
        content.alias("k0"),
        F.when(F.col(key).isNull(), F.lit(LEAST)).otherwise(own).alias("k1"),
        F.xxhash64(F.col(text).isNull(), *rest).alias("k2"),
    ]


def row_size(text: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1


def _listed(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A small table, written into the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(f.replace(' ', ': ') for f in fields.split(', '))}>>")))


def find_splitters(keys: DataFrame, total: int, rows: int, bounds: tuple, targets: dict[int, int], probes: int = PROBES) -> dict[int, Splitter]:
    """The splitter of each target: bytes wanted on the left -> how far it may be off.

    ``keys`` has k0, k1, k2 and size; ``bounds`` are the least and greatest k0.
    """
    found: dict[int, Splitter] = {}
    open_now = {0: Stretch((), *bounds, sorted(targets))} if rows else {}
    keyed = keys.withColumn("stretch", F.lit(0))
    before = {0: (0, 0)}
    ranges = [f(k).alias(f"{name}_{k}") for k in KEYS for name, f in (("low", F.min), ("high", F.max))]
    while open_now:
        each = max(16, probes // len(open_now))
        asked = [{"stretch": n, "level": len(s.fixed), "shift": s.shift(each), "origin": s.low >> s.shift(each)} for n, s in open_now.items()]
        probe = _listed(keys.sparkSession, asked, "stretch int, level int, shift int, origin bigint")
        value = F.element_at(F.array(*KEYS), F.col("level") + 1)
        bucket = F.call_function("shiftright", value, F.col("shift")) - F.col("origin")
        probed = keyed.join(F.broadcast(probe), "stretch").withColumn("bucket", bucket)
        counts = probed.groupBy("stretch", "bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *ranges).collect()
        own: dict[int, list] = {}
        for c in sorted(counts, key=lambda c: (c["stretch"], c["bucket"])):
            own.setdefault(c["stretch"], []).append(c)
        following: dict[int, Stretch] = {}
        opened, starts = [], {}
        for n, stretch in open_now.items():
            below, rows_below = before[n]
            waiting, depth = stretch.targets, len(stretch.fixed)
            for c in own[n]:
                here = [t for t in waiting if t <= below + c["bytes"]]
                waiting = waiting[len(here) :]
                low, high = c[f"low_k{depth}"], c[f"high_k{depth}"]
                pad = (LEAST,) * (len(KEYS) - 1 - depth)
                left = Splitter((*stretch.fixed, low, *pad), below, rows_below)
                right = Splitter((*stretch.fixed, high + 1, *pad), below + c["bytes"], rows_below + c["rows"])
                inside = []
                for t in here:
                    near = left if t - left.bytes <= right.bytes - t else right
                    if abs(t - near.bytes) <= targets[t] or (depth == len(KEYS) - 1 and low == high):
                        found[t] = near
                    else:
                        inside.append(t)
                if inside:
                    fixed = stretch.fixed
                    if low == high:
                        # one value here: the next part of the key tells rows apart, or nothing does
                        fixed = (*fixed, low)
                        while len(fixed) < len(KEYS) - 1 and c[f"low_k{len(fixed)}"] == c[f"high_k{len(fixed)}"]:
                            fixed = (*fixed, c[f"low_k{len(fixed)}"])
                    at = len(fixed)
                    opened.append({"stretch": n, "bucket": c["bucket"], "next": len(following)})
                    starts[len(following)] = (below, rows_below)
                    following[len(following)] = Stretch(fixed, c[f"low_k{at}"], c[f"high_k{at}"], inside)
                below, rows_below = below + c["bytes"], rows_below + c["rows"]
        if following:
            chosen = _listed(keys.sparkSession, opened, "stretch int, bucket bigint, next int")
            narrowed = probed.join(F.broadcast(chosen), ["stretch", "bucket"]).select(*KEYS, "size", F.col("next").alias("stretch"))
            keyed, _ = publish_with_facts(narrowed, "stretches", F.count(F.lit(1)).alias("n"))
        open_now, before = following, starts
    return found


def _place(key: Column, splitters: list[Splitter]) -> Column:
    """How many splitters are at or below the key, by binary search."""
    listed = json.dumps([dict(zip(KEYS, s.key, strict=True)) for s in splitters])
    held = F.from_json(F.lit(listed), "array<struct<k0 bigint, k1 bigint, k2 bigint>>")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))))

    def ahead(at: Column, step: Column) -> Column:
        beyond = (at + step <= len(splitters)) & (F.get(held, at + step - 1) <= key)
        return F.when(beyond, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), ahead)


def shard(
    docs: DataFrame,
    shards: int = 16,
    text: str = "text",
    key: str = "doc_id",
    tolerance: float = 0.0,
    part_bytes: int = PART_BYTES,
    max_parts: int = MAX_PARTS,
    probes: int = PROBES,
) -> DataFrame:
    """Rows in ``shards`` shards of near equal bytes: adds size, law, shard, slot and grown_shard.

    ``tolerance`` is how far, in parts of a shard's share, a boundary may be off; 0 asks
    for the nearest one. ``slot`` numbers the rows of a shard from 0 in key order. The law
    is not one of keys, so ``grown_shard`` is null.
    """
    if shards < 1 or part_bytes < 1 or max_parts < shards or tolerance < 0:
        raise ValueError("shards and part_bytes must be positive, max_parts no less than shards, tolerance not negative")
    key_of_row = row_key(docs, text, key)
    narrow = docs.select(*key_of_row, row_size(text).alias("size"))
    keys, facts = publish_with_facts(
        narrow, "shard-keys", F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("k0").alias("low"), F.max("k0").alias("high")
    )
    total, rows = facts["bytes"] or 0, facts["rows"]
    pieces = max(1, min(-(-total // (shards * part_bytes)), max_parts // shards))
    parts = shards * pieces
    # targets as whole bytes; those between shards win where two fall together
    targets = {total * p // parts: int(PART_TOLERANCE * total / parts) for p in range(1, parts) if p % pieces}
    targets |= {total * s // shards: int(tolerance * total / shards) for s in range(1, shards)}
    found = find_splitters(keys, total, rows, (facts["low"], facts["high"]), targets, probes)
    start = Splitter((LEAST,) * len(KEYS), 0, 0)
    splitters = [found.get(total * p // parts, start) for p in range(1, parts)]
    for p in range(1, len(splitters)):
        splitters[p] = max(splitters[p], splitters[p - 1], key=lambda s: s.key)
    first_of_part = [0, *(s.rows for s in splitters)]
    before = F.from_json(F.lit(json.dumps([n - first_of_part[p - p % pieces] for p, n in enumerate(first_of_part)])), "array<bigint>")

    kept = [c for c in docs.columns if c.lower() not in ADDED]
    placed = docs.select(F.struct(*kept).alias("row"), *key_of_row, row_size(text).alias("size"))
    part = _place(F.struct(*KEYS), splitters) if splitters else F.lit(0)
    dealt = placed.withColumn("part", part).repartitionById(parts, F.col("part"))
    in_part = Window.partitionBy("part").orderBy(*KEYS)
    numbered = dealt.withColumn("slot", F.row_number().over(in_part) - 1 + F.get(before, F.col("part")))
    return numbered.select(
        "row.*",
        "size",
        F.lit(LAW).alias("law"),
        F.expr(f"part div {pieces}").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
