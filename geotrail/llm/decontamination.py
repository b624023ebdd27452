"""Operator 9, benchmark decontamination with fingerprints of item-sized windows.

Words are runs of letters and digits, ASCII letters in lower case; a shingle is ``k``
consecutive words (all words of a shorter item). A shingle of an item weighs log(1 + items /
items that have it), one that the item lacks as much as a shingle of one item alone. For every
item length, windows of that many words slide over each document (the whole document if it is
shorter). A window whose shared weight cannot reach the similarity is passed over, which
loses nothing. The others get a 64-bit SimHash of their shingles; eight blocks of eight bits,
each tried with up to ``radius // 8`` flips, find every item fingerprint within ``radius``;
the exact weighted Jaccard similarity of the shingle sets decides.

The items travel to the tasks in parts of at most ``part_chars`` characters; a larger
benchmark takes one pass over the documents for each part. Items with a shingle are counted
over the whole benchmark, and nothing else depends on other items, so parts decide nothing.

Defined results: null or empty texts and items match nothing; repeated items are reported
once by id, with their best window, the earliest if windows tie; repeated documents are
reported each; a kept column named leaks is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geotrail.llm.encoding import kept_columns
from geotrail.llm.textbuf import find_words, gram_hashes, inside_rows, span_hashes, text_slices
from geotrail.scratch import publish

K = 5
SIMILARITY = 0.8
RADIUS = 20
PART_CHARS = 20_000_000
BLOCKS = 8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False
BITS = np.arange(64, dtype=np.uint64)
FLIPS = np.array([bin(x).count("1") for x in range(256)])
FILTER_BITS = 22


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts, ends and row pointers of the words of a slice."""
    starts, ends, pointers = find_words(data, offsets, APART)
    return span_hashes(LOWER[data], starts, ends), starts, ends, pointers


def fingerprints(signed: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash bytes of windows of ``count`` shingles, from running sums of signs."""
    return np.packbits(signed[starts + count] - signed[starts] >= 0, axis=1)


def signed_sums(grams: np.ndarray) -> np.ndarray:
    """Running sums, for each bit, of the shingles that have it less those that lack it."""
    signs = ((grams[:, None] >> BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])


def item_shingles(text: str | None, k: int) -> tuple[int, int, np.ndarray]:
    """Words, shingle size and shingles of an item, in order; no words, no shingles."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    hashes = word_hashes(data, np.array([0, len(data)]))[0] if len(data) else np.zeros(0, np.uint64)
    size = min(k, len(hashes))
    return len(hashes), size, gram_hashes(hashes, size) if size else np.zeros(0, np.uint64)


@dataclass
class Item:
    item_id: object
    words: int
    shingles: np.ndarray
    weights: np.ndarray
    fingerprint: np.ndarray


class ItemIndex:
    """Items of a part of the benchmark, by shingle size and length."""

    def __init__(self, rows: list[tuple[object, str]], counts: dict[int, tuple[np.ndarray, np.ndarray]], total: int, k: int, similarity: float, radius: int):
        """``counts``: for each shingle size, the sorted shingles of these items and the items that have them."""
        self.similarity, self.radius = similarity, radius
        plain = [(item_id, *item_shingles(text, k)) for item_id, text in rows]
        plain = [(i, n, size, g) for i, n, size, g in plain if n]
        self.sizes = sorted({size for _, _, size, _ in plain})
        self.known: dict[int, np.ndarray] = {}
        self.weight: dict[int, np.ndarray] = {}
        self.maybe: dict[int, np.ndarray] = {}
        self.rare = float(np.log1p(total))
        self.groups: dict[int, list[tuple[int, float, list[Item], np.ndarray]]] = {}
        for size in self.sizes:
            own = [(i, n, g) for i, n, s, g in plain if s == size]
            known, items_with = counts[size]
            self.known[size], self.weight[size] = known, np.log1p(total / items_with)
            self.maybe[size] = np.zeros(1 << FILTER_BITS, bool)
            self.maybe[size][known >> np.uint64(64 - FILTER_BITS)] = True
            by_length: dict[int, list[Item]] = {}
            for item_id, n, grams in own:
                shingles = np.unique(grams)
                mark = fingerprints(signed_sums(grams), np.array([0]), len(grams))[0]
                by_length.setdefault(n, []).append(Item(item_id, n, shingles, self.weights(size, shingles), mark))
            self.groups[size] = []
            near = FLIPS[np.arange(256)[:, None] ^ np.arange(256)] <= radius // BLOCKS
            for n, items in sorted(by_length.items()):
                marks = np.array([x.fingerprint for x in items])
                blocks = np.stack([near[:, marks[:, b]] for b in range(BLOCKS)])
                least = min(float(x.weights.sum()) for x in items)
                self.groups[size].append((n, least * similarity - 1e-9, items, blocks))

    def weights(self, size: int, grams: np.ndarray) -> np.ndarray:
        """Weight of shingles of items."""
        return self.weight[size][np.searchsorted(self.known[size], grams)]

    def hits(self, size: int, grams: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        at = np.flatnonzero(self.maybe[size][grams >> np.uint64(64 - FILTER_BITS)])
        found = np.minimum(np.searchsorted(self.known[size], grams[at]), len(self.known[size]) - 1)
        return at[self.known[size][found] == grams[at]]

    def search(self, hashes: np.ndarray, size: int, hits: np.ndarray) -> dict[object, tuple[float, int, int]]:
        """Best window (similarity, first word, words) of each item in one document."""
        grams = gram_hashes(hashes, size)
        shared = np.zeros(len(grams))
        shared[hits] = self.weights(size, grams[hits])
        shared = np.concatenate([[0], np.cumsum(shared)])
        best: dict[object, tuple[float, int, int]] = {}
        signed = None
        for words, least, items, blocks in self.groups[size]:
            span = min(words, len(hashes))
            count = span - size + 1
            starts = np.flatnonzero(shared[count:] - shared[:-count] >= least)
            if not len(starts):
                continue
            if signed is None:
                signed = signed_sums(grams)
            marks = fingerprints(signed, starts, count)
            near = np.zeros((len(starts), len(items)), bool)
            for b in range(BLOCKS):
                near |= blocks[b][marks[:, b]]
            for w, i in zip(*np.nonzero(near), strict=True):
                item = items[i]
                if FLIPS[marks[w] ^ item.fingerprint].sum() > self.radius:
                    continue
                own = np.unique(grams[starts[w] : starts[w] + count])
                held = np.isin(item.shingles, own, assume_unique=True)
                alike = float(item.weights[held].sum()) / (float(item.weights.sum()) + (len(own) - int(held.sum())) * self.rare)
                if alike >= self.similarity and alike > best.get(item.item_id, (0.0, 0, 0))[0]:
                    best[item.item_id] = (alike, int(starts[w]), span)
        return best


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[Column | str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = K,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """``keep`` columns with ``leaks``: array<struct<item_id, similarity, first_word, n_words, char_start, char_end>>.

    Every document comes out once, in place; nothing is shuffled.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    total, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-chars // part_chars))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    counted = publish(_count_shingles(items, k), "shingle-counts")
    kind = items.schema["item_id"].dataType
    leak = f"struct<item_id:{kind.simpleString()},similarity:double,first_word:long,n_words:long,char_start:long,char_end:long>"
    leaks = F.array().cast(f"array<{leak}>")
    arrow_leaks = pa.list_(
        pa.struct([("item_id", to_arrow_type(kind)), ("similarity", pa.float64())] + [(c, pa.int64()) for c in ("first_word", "n_words", "char_start", "char_end")])
    )
    for part in range(parts):
        mine = [tuple(r) for r in items.where(F.col("part") == part).select("item_id", "text").collect()]
        own = counted.where(F.col("part") == part).orderBy("size", "gram").toPandas()
        counts = {int(size): (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for size, g in own.groupby("size")}
        counts = {size: (grams[order], n[order]) for size, (grams, n) in counts.items() for order in [np.argsort(grams)]}
        index = ItemIndex(mine, counts, total, k, similarity, radius)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        # only the texts go to Python; the other columns wait in the JVM
        scan = F.arrow_udf(_scanner(shared, arrow_leaks), f"array<{leak}>").asNondeterministic()
        leaks = F.concat(leaks, scan(F.col(text).cast("string")))
    kept = F.struct(*kept_columns(docs, keep, ["leaks"])).alias("kept")
    return docs.select(kept, leaks.alias("leaks")).select("kept.*", "leaks")


def _count_shingles(items: DataFrame, k: int) -> DataFrame:
    """Shingles of the items of each part (part, size, gram), with the items of the whole benchmark that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, size, grams = item_shingles(text, k)
                own = np.unique(grams)
                columns = [np.full(len(own), part), np.full(len(own), size), own.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "size", "gram"])

    held = items.select("part", "text").mapInArrow(run, "part long, size long, gram long")
    counts = held.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n"), F.collect_set("part").alias("parts"))
    return counts.select(F.explode("parts").alias("part"), "size", "gram", "n")


def _scanner(shared, arrow_leaks: pa.DataType):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        for texts in batches:
            found: dict[int, list[dict]] = {}
            for row, data, offsets in text_slices(texts):
                hashes, starts, ends, pointers = word_hashes(data, offsets)
                for size in index.sizes if len(hashes) else []:
                    grams = gram_hashes(hashes, size)
                    hits = index.hits(size, grams)
                    hits = hits[inside_rows(pointers, size, len(grams))[hits]] if len(hits) else hits
                    for k in np.unique(np.searchsorted(pointers, hits, "right") - 1):
                        a, b = int(pointers[k]), int(pointers[k + 1])
                        own = hits[np.searchsorted(hits, a) : np.searchsorted(hits, b)] - a
                        for item, (alike, first, n) in index.search(hashes[a:b], size, own).items():
                            edges = [starts[a + first], ends[a + first + n - 1]]
                            chars = [int(np.count_nonzero((data[offsets[k] : e] & 0xC0) != 0x80)) for e in edges]
                            found.setdefault(row + int(k), []).append(
                                {"item_id": item, "similarity": alike, "first_word": first, "n_words": n, "char_start": chars[0], "char_end": chars[1]}
                            )
            yield pa.array([found.get(r, []) for r in range(len(texts))], arrow_leaks)

    return run
