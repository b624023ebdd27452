"""Operator 6, best-fit packing with Martello and Toth's dominance reduction.

1. Documents are encoded and, if longer than a sequence, cut from the end into full pieces.
2. Only the number of pieces of each length reaches the driver: at most ``capacity``
   numbers, whatever the input. There the reduction fixes sets of up to three lengths that
   provably dominate every other way to fill a sequence, as often as their counts allow;
   best fit, longest first, packs the rest. The result is a list of rank ranges of each
   length, again bounded by the capacity.
3. Every piece gets its rank among the pieces of its length, in hash buckets that are
   numbered apart and then shifted, so that a length held by a third of all pieces is
   spread over many tasks; the rank tells sequence and offset.

Defined results: null text counts as empty and gives one piece, the end mark alone; empty
input gives no rows; repeated rows are packed each; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail.llm.encoding import ENCODED_BYTES, column_of, encoder, tokenizer_path
from geotrail.llm.textbuf import text_slices
from geotrail.scratch import publish_with_facts

PIECE = "piece int, start long, length long, ids_crc32 long"
BUCKET_ROWS = 50_000
"""Pieces that are numbered together, about."""


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """Bounds of the pieces of ``n`` ids: full ones, but for the first."""
    head = n % capacity or min(n, capacity)
    edges = [0, *range(head, n + 1, capacity)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def encode_pieces(
    docs: DataFrame, capacity: int, end_id: int, tokenizer: str, text: str, doc_id: str, with_ids: bool = False
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = tokenizer_path(tokenizer)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, mark = encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            ids = column_of(batch, "doc_id")
            for row, data, offsets in text_slices(column_of(batch, "text"), ENCODED_BYTES):
                tokens, pointers = coder.encode(data, offsets)
                tokens, owner, out, pieces = tokens.astype("<u4"), [], [], []
                for k in range(len(offsets) - 1):
                    own = np.concatenate([tokens[pointers[k] : pointers[k + 1]], mark])
                    for p, (a, b) in enumerate(cut_pieces(len(own), capacity)):
                        owner.append(row + k)
                        out.append((p, a, b - a, zlib.crc32(own[a:b].tobytes())))
                        if with_ids:
                            pieces.append(own[a:b].astype(np.int64))
                table = np.array(out, np.int64)
                columns = [ids.take(pa.array(owner)), pa.array(table[:, 0].astype(np.int32))]
                columns += [pa.array(table[:, c]) for c in range(1, 4)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, {PIECE}" + (", ids array<long>" if with_ids else ""))


@dataclass
class Plan:
    """Sequences by kind: ``times`` of ``[(length, copies), ...]``, numbered from 0."""

    kinds: list[tuple[int, list[tuple[int, int]]]]
    fixed: int
    """Sequences that the reduction made."""

    @property
    def sequences(self) -> int:
        return sum(times for times, _ in self.kinds)

    def ranges(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first rank, end rank, first sequence, copies in each, first offset)."""
        out, rank, sequence = [], {}, 0
        for times, content in self.kinds:
            offset = 0
            for length, copies in content:
                at = rank.get(length, 0)
                out.append((length, at, at + times * copies, sequence, copies, offset))
                rank[length] = at + times * copies
                offset += length * copies
            sequence += times
        return out


def _take(left: np.ndarray, content: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """Fix a set as often as its lengths last."""
    copies = [(length, content.count(length)) for length in dict.fromkeys(content)]
    times = min(int(left[length]) // n for length, n in copies)
    for length, n in copies:
        left[length] -= times * n
    return times, copies


def _largest_pair(left: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two lengths that fill ``room`` most, as far as they are there."""
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return None
    other = have[np.maximum(np.searchsorted(have, room - have, "right") - 1, 0)]
    alone = (other == have) & (left[have] < 2)
    lower = np.searchsorted(have, other, "left") - 1
    other = np.where(alone & (lower >= 0), have[np.maximum(lower, 0)], other)
    good = (have + other <= room) & ~((other == have) & (left[have] < 2))
    if not good.any():
        return None
    best = np.argmax(np.where(good, have + other, -1))
    return int(have[best]), int(other[best])


def reduce_dominated(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fix dominating sets for every length, longest first; ``left`` keeps what is not fixed.

    A set dominates if any other set that fits with the length could be exchanged for it
    without needing another sequence: the length alone if nothing fits; with the longest
    partner if that fills the sequence, if no two fit, or if it is at least as long as the
    best two; with the best two if the longest partner is one of them and no three fit.
    """
    fixed = []
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            room = capacity - length
            fits = np.flatnonzero(left[: room + 1])
            smallest: list[int] = []
            for s in fits[:3]:
                smallest += [int(s)] * int(min(3, left[s]))
            pair = _largest_pair(left, room) if len(smallest) > 1 else None
            left[length] += 1
            if not len(fits):
                content = [length]
            elif fits[-1] == room or pair is None or fits[-1] >= sum(pair):
                content = [length, int(fits[-1])]
            elif max(pair) == fits[-1] and (len(smallest) < 3 or sum(smallest[:3]) > room):
                content = [length, *sorted(pair, reverse=True)]
            else:
                break
            fixed.append(_take(left, content))
    return fixed


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, for all pieces of a length at once."""
    open_kinds: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in range(capacity, 0, -1):
        need = int(left[length])
        for room in range(length, capacity):
            while need and open_kinds.get(room):
                times, content = open_kinds[room].pop()
                each = room // length
                full = min(times, need // each)
                rest = min(need - full * each, each - 1) if full < times else 0
                need -= full * each + rest
                for n, copies in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        open_kinds.setdefault(room - copies * length, []).append((n, [*content, (length, copies)]))
                if times - full - (1 if rest else 0):
                    open_kinds[room].append((times - full - (1 if rest else 0), content))
                    break
        each = capacity // length
        for n, copies in ((need // each, each), (1 if need % each else 0, need % each)):
            if n:
                open_kinds.setdefault(capacity - copies * length, []).append((n, [(length, copies)]))
    return [kind for room in sorted(open_kinds) for kind in open_kinds[room]]


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Pack ``counts`` pieces of each length into few sequences of ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    fixed = reduce_dominated(left, capacity)
    return Plan(fixed + best_fit(left, capacity), sum(times for times, _ in fixed))


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 2,
    tokenizer: str = "byte_bpe_50k.json",
    text: str = "text",
    doc_id: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Place of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    coded = encode_pieces(docs, capacity, end_id, tokenizer, text, doc_id, with_ids)
    pieces, facts = publish_with_facts(coded, "pieces", F.count(F.lit(1)).alias("rows"))
    buckets = max(1, -(-facts["rows"] // BUCKET_ROWS))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(counts, capacity).ranges()
    places = spark.createDataFrame(
        plan or [(0, 0, 0, 0, 1, 0)], "length long, rank_from long, rank_to long, first long, copies long, base long"
    )
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(shifts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "bucket")
    placed = ranked.join(
        F.broadcast(places.withColumnRenamed("length", "size")),
        (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    )
    step = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + F.floor(step / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("base") + step % F.col("copies") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces packed ``with_ids``; a group holds one sequence at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
