"""Operator 8, substring deduplication with compressed full-text indexes.

A window is ``window`` consecutive words. A word is removed if a window over it also starts
in a document with a smaller id.

1. Every window names one place: the ``gram`` words in it whose hash is smallest.
   Windows with equal words name the same grams, so a run of windows with one such gram (a
   segment) only needs to meet the segments with that gram. Segments are ranged by gram and
   document, so a gram of a third of all documents spreads over many tasks, and segments
   whose gram one document has alone are passed over. The grams at the edges of a task are
   always kept; that only costs work.
2. Segments with equal words become one, with its smallest document. Their words are
   fetched from that document.
3. Shards of grams, of bounded size, get an FM-index each: suffix array, BWT, wavelet
   matrix. Backward search gives for every window of the shard's segments the interval of
   equal windows, and so the smallest document that has it. A gram with more than ``crowd``
   distinct segments (a line that many documents hold amid other text) is not given to one
   shard; its windows are grouped by their hash instead, which is exact as well.
4. Segments take their answer back to the documents.

Before texts are shuffled, a Bloom filter of fixed size tells which documents cannot matter;
if it is too full to tell, more texts are shuffled and nothing else changes. A text goes to a
task and back once, in batches of bounded size, and only a text that loses words comes back
a second time.

Defined results: null and empty texts have no words; rows with a null id neither lose words
nor cause a loss; repeated rows of one id do not cause each other's loss; other columns are
kept as they are, but for those named like an added one, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from geotrail.llm.docfilter import document_filter, may_matter, passes, with_bit
from geotrail.llm.encoding import column_of, kept_columns
from geotrail.llm.fmindex import FMIndex
from geotrail.llm.textbuf import find_words, gram_hashes, inside_rows, mix, powers, ragged, rows_of, span_hashes, text_slices
from geotrail.scratch import publish, publish_with_facts, setting

WINDOW = 13
GRAM = 5
SHARD_WORDS = 150_000
CROWD = 2_000
BATCH_BYTES = 4 << 20
"""Bytes of rows that are sent to Python at once while repeats are searched."""


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words."""
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def segments(words: np.ndarray, pointers: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first word, windows, gram hash and content hash of every segment of a slice."""
    count = len(words) - window + 1
    if count < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = gram_hashes(words, gram)
    least, place = grams[:count].copy(), np.zeros(count, np.int64)
    for k in range(1, window - gram + 1):
        here = grams[k : k + count]
        better = here < least
        least[better] = here[better]
        place[better] = k
    place += np.arange(count)
    ok = np.flatnonzero(inside_rows(pointers, window, count))
    row = rows_of(pointers)[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (place[ok[1:]] != place[ok[:-1]]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(ok)))
    starts = ok[first]
    content = run_hashes(words, starts, starts + n + window - 1)
    return row[first], starts - pointers[row[first]], n, least[starts], content


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, pointers = find_words(data, offsets)
    return span_hashes(data, starts, ends), starts, ends, pointers


def _all_segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column_of(batch, "doc_id")
            for row, data, offsets in text_slices(column_of(batch, "text")):
                words, _, _, pointers = _words(data, offsets)
                owner, at, n, grams, content = segments(words, pointers, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), ids.take(pa.array(owner + row)), pa.array(at * 64 + n), pa.array(content.view(np.int64))],
                    names=["gram", "doc_id", "place", "content"],
                )

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "gram long, doc_id long, place long, content long")


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, ordered by gram and document, whose gram several documents have or that touch an edge."""
    held: list[pa.RecordBatch] = []  # the last gram so far, while one document has it alone
    last_gram = last_doc = None
    flowing = True  # the first gram of the task is kept
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, doc = column_of(batch, "gram").to_numpy(), column_of(batch, "doc_id").to_numpy()
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        ends = np.append(starts[1:], len(gram))
        keep = doc[starts] != doc[ends - 1]
        if last_gram is None:
            keep[0] = True
        elif gram[0] == last_gram:
            keep[0] |= flowing or doc[0] != last_doc
            if keep[0]:
                yield from held
                held = []
        if last_gram is None or gram[0] != last_gram:
            held = []
        mask = np.repeat(keep, ends - starts)
        if not keep[-1]:
            tail = batch.slice(starts[-1])
            held = held + [tail] if len(starts) == 1 else [tail]
        else:
            held = []
        flowing, last_gram, last_doc = bool(keep[-1]), gram[-1], doc[-1]
        if mask.any():
            yield batch.filter(pa.array(mask))
    yield from held


def _fetch(docs: DataFrame, window: int) -> DataFrame:
    """Words of the wanted segments of each document; a segment that is not as described is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted, ids = column_of(batch, "text"), column_of(batch, "wanted"), column_of(batch, "doc_id").to_numpy()
            inner = wanted.flatten()
            lengths = np.diff(wanted.offsets.to_numpy())
            fields = [inner.field(c).to_numpy() for c in range(3)]
            pointer = np.concatenate([[0], np.cumsum(lengths)])
            for row, data, offsets in text_slices(texts):
                words, _, _, pointers = _words(data, offsets)
                rows = len(offsets) - 1
                own = slice(pointer[row], pointer[row + rows])
                owner = np.repeat(np.arange(rows), lengths[row : row + rows])
                place, gram, content = (f[own] for f in fields)
                starts = pointers[owner] + place // 64
                size = place % 64 + window - 1
                good = starts + size <= pointers[owner + 1]
                owner, gram, content, starts, size = (x[good] for x in (owner, gram, content, starts, size))
                good = run_hashes(words, starts, starts + size).view(np.int64) == content
                owner, gram, content, starts, size = (x[good] for x in (owner, gram, content, starts, size))
                flat = words[ragged(starts, size)].view(np.int64)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(content), pa.array(ids[row + owner]), lists], names=["gram", "content", "first_doc", "words"]
                )

    return docs.mapInArrow(run, "gram long, content long, first_doc long, words array<long>")


def search_shard(part: pd.DataFrame, window: int) -> pd.DataFrame:
    """For every segment of a shard the smallest document of each of its windows."""
    runs = [np.asarray(w) for w in part["words"]]
    size = np.array([len(w) for w in runs])
    kinds, symbols = np.unique(np.concatenate(runs), return_inverse=True)
    heads = np.cumsum(size + 1) - size  # a separator before every segment
    text = np.zeros(int((size + 1).sum()) + 1, np.int64)
    text[ragged(heads, size)] = symbols + 1
    index = FMIndex(text, len(kinds) + 1, window)
    count = size - window + 1
    ends = ragged(heads + window - 1, count)
    first = part["first_doc"].to_numpy()
    owner = np.repeat(np.arange(len(size)), count)
    _, low, high = index.matches(text, ends, window)
    least = first[owner]
    many = np.flatnonzero(high - low > 1)
    if len(many):
        whose = np.repeat(np.arange(len(size) + 1), np.append(size + 1, 1))
        by_order = np.append(first, np.iinfo(np.int64).max)[whose][index.order]
        starts, which = np.unique(low[many], return_inverse=True)
        stops = np.empty(len(starts), np.int64)
        stops[which] = high[many]
        edges = np.stack([starts, stops], 1).ravel()
        smallest = np.minimum.reduceat(np.append(by_order, np.iinfo(np.int64).max), edges)[::2]
        least[many] = smallest[which]
    lists = np.split(least, np.cumsum(count)[:-1])
    return pd.DataFrame({"gram": part["gram"], "content": part["content"], "least": lists})


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Documents (doc_id, text) with repeats: doc_id, spans array<struct<place, mask>>.

    ``place div 64`` is the first word of a segment; bit k of ``mask`` says that the window
    k words later is a repeat.
    """
    if not 0 < window - gram + 1 < 64:
        raise ValueError("a window has at least one gram, and fewer than 64")
    every = _all_segments(docs, window, gram)
    ranged = every.repartitionByRange("gram", "doc_id").sortWithinPartitions("gram", "doc_id")
    shared = publish(ranged.mapInArrow(_shared_only, ranged.schema), "segments")

    distinct = shared.groupBy("gram", "content").agg(F.min(F.struct("doc_id", "place")).alias("one"))
    wanted = publish(distinct.select("one.doc_id", "one.place", "gram", "content"), "distinct")
    texts = may_matter(docs.select("doc_id", "text"), document_filter(wanted.select("doc_id")))
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("place", "gram", "content")).alias("wanted"))
    fetched, facts = publish_with_facts(
        _fetch(texts.join(lists, "doc_id"), window), "contents", F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")
    )
    sizes = fetched.groupBy("gram").agg((F.count(F.lit(1)) > crowd).alias("crowded"))
    crowded = publish(sizes.where("crowded").select("gram"), "crowded")
    shards = 1 + facts["words"] // SHARD_WORDS
    calm = fetched.join(crowded, "gram", "left_anti").withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    searched = calm.groupBy("shard").applyInPandas(lambda part: search_shard(part, window), "gram long, content long, least array<long>")

    each = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - window + 1), lambda k: F.slice("words", k, window)))
    windows = fetched.join(crowded, "gram", "left_semi").select("gram", "content", "first_doc", each.alias("k", "own"))
    windows = windows.select("gram", "content", "first_doc", "k", F.xxhash64("own").alias("h1"), F.xxhash64("own", F.lit(1)).alias("h2"))
    least = windows.groupBy("h1", "h2").agg(F.min("first_doc").alias("least"))
    grouped = windows.join(least, ["h1", "h2"]).groupBy("gram", "content").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "least"))), lambda s: s["least"]).alias("least")
    )
    answers = publish(searched.unionByName(grouped), "answers")

    hit = shared.join(answers, ["gram", "content"]).where(F.array_min("least") < F.col("doc_id"))
    bits = F.aggregate(
        F.sequence(F.lit(0), F.size("least") - 1),
        F.lit(0).cast("long"),
        lambda mask, k: mask + F.when(F.element_at("least", k + 1) < F.col("doc_id"), F.pow(F.lit(2.0), k).cast("long")).otherwise(F.lit(0).cast("long")),
    )
    return hit.select("doc_id", F.struct("place", bits.alias("mask")).alias("span")).groupBy("doc_id").agg(F.collect_set("span").alias("spans"))


def covered(n_words: int, spans: list[dict], window: int) -> np.ndarray:
    """Which words of a document a repeated window covers."""
    edge = np.zeros(n_words + 1, np.int64)
    if spans:
        place = np.array([s["place"] for s in spans], np.int64) >> 6
        mask = np.array([s["mask"] for s in spans], np.int64)
        bits = (mask[:, None] >> np.arange(63)) & 1
        starts = (place[:, None] + np.arange(63))[bits == 1]
        starts = starts[starts + window <= n_words]
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


REPEATED = "n_words long, n_removed long, kept_text string, kept_sha256 string"


def cut_slices(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches (kept, text, spans) with what is left of each text, a slice of texts at a time.

    ``kept_text`` is null where nothing goes: the text itself is there.
    """
    for batch in batches:
        kept, texts, spans = column_of(batch, "kept"), column_of(batch, "text"), column_of(batch, "spans")
        for row, data, offsets in text_slices(texts):
            counts, removed, texts_out, digests = [], [], [], []
            starts, ends, pointers = find_words(data, offsets)
            whole = data.tobytes()
            rows = len(offsets) - 1
            for k in range(rows):
                a, b = starts[pointers[k] : pointers[k + 1]], ends[pointers[k] : pointers[k + 1]]
                gone = covered(len(a), spans[row + k].as_py() or [], window)
                counts.append(len(a))
                removed.append(int(gone.sum()))
                if not removed[-1]:
                    texts_out.append(None)
                    digests.append(hashlib.sha256(b" ".join(whole[offsets[k] : offsets[k + 1]].split())).hexdigest())
                    continue
                before = np.append(offsets[k], b[:-1])
                places = np.flatnonzero(~gone).tolist()
                left = b"".join(whole[before[i] : b[i]] for i in places) + (whole[b[-1] : offsets[k + 1]] if places else b"")
                texts_out.append(left.decode())
                digests.append(hashlib.sha256(b" ".join(whole[a[i] : b[i]] for i in places)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [kept.slice(row, rows), texts.slice(row, rows), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts_out, pa.string()), pa.array(digests, pa.string())],
                names=["kept", "text", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed, kept_text and kept_sha256.

    ``kept_text`` is the text itself if nothing goes, else the text without the removed words,
    each with the white space before it; ``kept_sha256`` is that of the kept words joined by
    single spaces.
    """
    added = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    kept = kept_columns(docs, None, added)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    # shuffle files go with the table they were for, not when the driver next collects garbage
    cleanup = setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)), cleanup:
        repeats = publish(find_repeats(plain, window, gram), "repeats")
    bits = document_filter(repeats.select("doc_id"))
    # a text that needs no cast is carried as such, not among the kept columns as well
    once = len(kept) > 1 and text in docs.columns and text.lower() not in added and docs.schema[text].dataType == StringType()
    carried = [c for c in kept if c != text] if once else kept
    rows = docs.select(F.struct(*carried).alias("kept"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    span = "array<struct<place:bigint,mask:bigint>>"
    out = f"kept {rows.schema['kept'].dataType.simpleString()}, text string, {REPEATED}"
    rest = with_bit(rows).withColumn("spans", F.lit(None).cast(span))
    touched = with_bit(may_matter(rows, bits).join(repeats, "doc_id", "left")).select(rest.columns)
    shared = spark.sparkContext.broadcast(bits)

    def run_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.filter(pa.array(~passes(batch, shared.value))) for batch in batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_slices(batches, window)

    done = rest.mapInArrow(run_rest, out).unionByName(touched.mapInArrow(run, out))
    columns = [F.col("text").alias(c) if c == text else F.col("kept").getField(c).alias(c) for c in kept] if once else ["kept.*"]
    return done.select(*columns, "n_words", "n_removed", F.coalesce("kept_text", "text").alias("kept_text"), "kept_sha256")
