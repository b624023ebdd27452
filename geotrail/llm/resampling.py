"""Operator 12, target-distribution importance resampling with a bracketed cutoff.

Words of every whole text are hashed to buckets once and kept as arrays of small numbers.
Counting the buckets of the corpus and of the target gives a table of gains, and an array
lookup scores a document: its weight. A draw without replacement takes the documents with
the highest weight plus Gumbel noise, which follows from the id alone. The cutoff is found
without sorting the corpus: a mergeable quantile sketch proposes a bracket of scores, exact
counts of the rows outside it say whether the cutoff lies inside, the bracket is widened
until it does, and only the rows of the bracket are sorted to find the cutoff row. Then the
rows at or above it get their ranks.

Memory of a Python task is a chunk of text (words do not cross chunks) and the bucket
numbers of an Arrow batch; the driver sees one count for each bucket, two scores and a row.

Defined results: a null or empty text has no words, weight 0, and is never drawn while
``min_words`` is above 0; a null id takes noise as the empty text does and sorts first;
ties go to the smaller id, then to the smaller number of words, and rows equal in all of
these are drawn in any order; without documents, or with less than one to draw, nothing is
drawn. Only the key of a row is kept, so no other column can clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.encoding import column_of
from geotrail.operators.gather import split_evenly
from geotrail.operators.numbering import totals_before
from geotrail.scratch import publish, publish_with_facts

BUCKETS = 10_000
CHUNK_BYTES = 1 << 20
SHORT = 48
"""Bytes up to which words are hashed many at a time."""
SKETCH_K = 2_000
MARGIN = 0.004
"""Half the width of the first bracket, as a share of the rows; the sketch errs by about half of it."""
SKETCH_GROUPS = 64

# The letters A to Z become a to z; words are runs of digits, of those letters and of bytes above 127.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of every word; byte after byte, for all words that have one there."""
    length = ends - starts
    longest_first = np.argsort(-length, kind="stable")
    first, left = starts[longest_first], length[longest_first]
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    n_short = np.searchsorted(-left, -SHORT)
    for at in range(int(min(left[0], SHORT)) if len(left) else 0):
        n = np.searchsorted(-left, -at)
        state[:n] = _CRC[(state[:n] ^ data[first[:n] + at]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[longest_first] = ~state
    for k in longest_first[:n_short]:
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes())
    return out


def bucket_words(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all rows, one after the other, and the number of words of each row."""
    found, counts = [np.zeros(0, np.uint16 if buckets <= 1 << 16 else np.uint32)], np.zeros(len(offsets) - 1, np.int64)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        upto = min(at + CHUNK_BYTES, end)
        chunk = _LOWER[data[at:upto]]
        inside = _WORD[chunk]
        if upto < end and inside[-1] and upto not in offsets[np.searchsorted(offsets, upto) :][:1]:
            # cut where the last word starts; a word longer than the chunk is taken whole
            row_start = int(offsets[np.searchsorted(offsets, upto, "right") - 1])
            gaps = np.flatnonzero(~inside)
            cut = max(int(gaps[-1]) + 1 + at if len(gaps) else at, row_start)
            if cut > at:
                upto = cut
            else:
                stop = int(offsets[np.searchsorted(offsets, upto, "right")])
                while upto < stop and _WORD[_LOWER[data[upto]]]:
                    upto += 1
            chunk, inside = _LOWER[data[at:upto]], _WORD[_LOWER[data[at:upto]]]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = np.unique(offsets[(offsets > at) & (offsets < upto)]) - at
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        found.append((word_crcs(chunk, starts, ends) % np.uint32(buckets)).astype(found[0].dtype))
        rows = np.searchsorted(offsets, starts + at, "right") - 1
        counts += np.bincount(rows, minlength=len(counts))
        at = upto
    return np.concatenate(found), counts


def hash_words(docs: DataFrame, text: str, key: str | None, buckets: int) -> DataFrame:
    """Rows key, n_features and the bucket of every word, in order, as a binary column of unsigned 16-bit numbers."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be 1 to 65536")
    chosen = docs.select(F.lit(0).alias("key") if key is None else F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_of(batch, "text").fill_null("").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            found, counts = bucket_words(data, offsets, buckets)
            ends = np.concatenate([[0], np.cumsum(counts * 2)]).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([column_of(batch, "key"), pa.array(counts), packed.cast(pa.binary())], names=["key", "n_features", "buckets"])

    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"key {kind}, n_features long, buckets binary")


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    column = column_of(batch, "buckets")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].view(np.uint16) if raw is not None and len(raw) else np.zeros(0, np.uint16)


def count_buckets(hashed: DataFrame, buckets: int) -> np.ndarray:
    """How many words fall into each bucket; a task adds up its own before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = hashed.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed ratio of target to corpus, rounded down."""
    buckets, all_corpus, all_target = float(len(corpus)), float(corpus.sum()), float(target.sum())
    ratio = (target + 1.0) * (all_corpus + buckets) / ((corpus + 1.0) * (all_target + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def weigh(hashed: DataFrame, table: np.ndarray) -> DataFrame:
    """key, n_features and weight: the gains of the words of each row, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = column_of(batch, "n_features").to_numpy()
            sums = np.concatenate([[0], np.cumsum(table[_flat(batch)])])
            ends = np.cumsum(n)
            weight = sums[ends] - sums[ends - n]
            yield pa.RecordBatch.from_arrays([column_of(batch, "key"), column_of(batch, "n_features"), pa.array(weight)], names=["key", "n_features", "weight"])

    kind = hashed.schema["key"].dataType.simpleString()
    return hashed.mapInArrow(run, f"key {kind}, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise that follows from the key alone, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


ORDER = ["down", "key", "n_features"]
"""Sort columns: ``down`` is the negative score."""


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with rank, from 1, in the order of ORDER; sorted in ranges, of which only row counts pass one window."""
    ranged = split_evenly(rows, ORDER, sort=ORDER)
    placed = publish(ranged.withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranges")
    sizes = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_from"))
    starts = totals_before(sizes, ["_task"], "_n").select("_task", "_from", "before")
    rank = (F.col("_place") - F.col("_from") + F.col("before") + 1).cast("long")
    return placed.join(F.broadcast(starts), "_task").withColumn("rank", rank).drop("_task", "_place", "_from", "before")


def bracket(scores: DataFrame, n: int, wanted: int, margin: float = MARGIN, sketch_k: int = SKETCH_K) -> tuple[int, int, int]:
    """Scores low and high with the ``wanted``-th highest of ``n`` between, and the exact count above high.

    Sketches are merged in groups of tasks first. Each widening asks for exact counts.
    """
    own = scores.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("g")).agg(F.kll_sketch_agg_bigint("score", F.lit(sketch_k)).alias("s"))
    sketch = publish(own.agg(F.kll_merge_agg_bigint("s").alias("s"), F.lit(0).alias("one")), "sketch")
    share = 1 - wanted / n
    below, over = margin, margin
    least, most = None, None
    while True:
        if share - below > 0 and share + over < 1:
            asked = F.array(F.lit(share - below), F.lit(share + over))
            low, high = sketch.select(F.kll_sketch_get_quantile_bigint("s", asked)).first()[0]
        else:
            if least is None:
                least, most = scores.agg(F.min("score"), F.max("score")).first()
            low = sketch.select(F.kll_sketch_get_quantile_bigint("s", F.lit(share - below))).first()[0] if share - below > 0 else least
            high = sketch.select(F.kll_sketch_get_quantile_bigint("s", F.lit(share + over))).first()[0] if share + over < 1 else most
        above, at_least = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < wanted <= at_least:
            return low, high, above
        below, over = (below * 4, over) if wanted > at_least else (below, over * 4)


def draw(scored: DataFrame, eligible: Column, n: int, wanted: int, margin: float = MARGIN, sketch_k: int = SKETCH_K) -> DataFrame:
    """Adds rank, 1 for the highest score, to the ``wanted`` best of the ``n`` eligible rows; null for the others.

    ``scored`` has key, n_features and score, and is read several times.
    """
    unranked = F.lit(None).cast("long")
    if wanted < 1:
        return scored.withColumn("rank", unranked)
    rows = scored.where(eligible).withColumn("down", -F.col("score"))
    low, high, above = bracket(rows, n, wanted, margin, sketch_k)
    near = _numbered(rows.where(F.col("score").between(low, high)).select(*ORDER))
    cutoff = near.where(F.col("rank") == wanted - above).first()
    last = F.struct(*(F.lit(cutoff[c]).cast(rows.schema[c].dataType).alias(c) for c in ORDER))
    drawn = F.struct(*ORDER) <= last
    ranked = _numbered(rows.where((F.col("score") >= low) & drawn))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    others = scored.withColumn("down", -F.col("score")).where(~F.coalesce(eligible, F.lit(False)) | ~drawn).withColumn("rank", unranked)
    return ranked.unionByName(others).drop("down")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    text: str = "text",
    key: str = "doc_id",
    target_text: str = "text",
    buckets: int = BUCKETS,
    seed: int = 2024,
) -> DataFrame:
    """Scores of all documents and ranks of those drawn: key, n_features, weight, score, rank.

    Of the documents with ``min_words`` words or more, ``percent`` of a hundred are drawn,
    rounded down.
    """
    if not 0 <= percent <= 100 or min_words < 0:
        raise ValueError("percent must be 0 to 100, min_words not negative")
    hashed = publish(hash_words(docs, text, key, buckets), "words")
    table = gains(count_buckets(hashed, buckets), count_buckets(hash_words(target, target_text, None, buckets), buckets))
    eligible = F.col("n_features") >= min_words
    weighed = weigh(hashed, table).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed))
    scored, facts = publish_with_facts(weighed, "scores", F.count_if(eligible).alias("n"))
    n = facts["n"] or 0
    ranked = draw(scored, eligible, n, percent * n // 100)
    return ranked.select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
