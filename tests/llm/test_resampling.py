"""Resampling against a plain version; chunks, brackets and odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geotrail.llm import queries, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets_of(text, buckets=10_000):
    return [zlib.crc32(w.encode()) % buckets for w in WORD.findall((text or "").translate(LOWER))]


def plain(docs, target, percent=10, min_words=20, seed=2024):
    own = [(i, buckets_of(t)) for i, t in docs]
    s = np.bincount([b for _, f in own for b in f], minlength=10_000).tolist()
    t = np.bincount([b for x in target for b in buckets_of(x)], minlength=10_000).tolist()
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = able[: percent * len(able) // 100]
    places = {}
    for k, r in enumerate(drawn):
        places.setdefault(r, []).append(k + 1)
    return sorted(((*r, places[r].pop() if places.get(r) else None) for r in rows), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


pieces = st.one_of(st.sampled_from(["a", "Zz9", " ", "é", "-", "　", "word" * 20]), st.text(max_size=4))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(pieces, max_size=6).map("".join), max_size=6), st.sampled_from([1, 2, 5, 16, 1 << 20]))
def test_words_in_chunks(texts, chunk):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    whole, resampling.CHUNK_BYTES = resampling.CHUNK_BYTES, chunk
    try:
        got, counts = resampling.bucket_words(data, offsets, 10_000)
    finally:
        resampling.CHUNK_BYTES = whole
    want = [buckets_of(r.decode()) for r in raw]
    assert counts.tolist() == [len(w) for w in want] and got.tolist() == [b for w in want for b in w]


def test_scores_and_ranks(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert found(queries.op12_resampling(spark, sf_dir)) == plain(docs, target)


def test_odd_rows(spark):
    rows = [(k, "good words here " * 8 if k % 2 else "bad stuff " * (k % 30)) for k in range(300)]
    rows += [(5, "good words here " * 8)] * 40 + [(None, "good words here " * 8)] * 3 + [(400, None), (401, ""), (402, "word" * 400_000), (403, "a b " * 500_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rank int, score string").repartition(7)
    target = spark.createDataFrame([("good words",), (None,), ("Here-good",)], "text string")
    plain_target = ["good words", None, "Here-good"]
    for percent in (10, 50, 100):
        assert found(resampling.resample(docs, target, percent)) == plain(rows, plain_target, percent)
    assert {r["rank"] for r in resampling.resample(docs, target, 0).collect()} == {None}
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert {r["rank"] for r in resampling.resample(docs, target.limit(0), 10, min_words=10**9).collect()} == {None}
    with pytest.raises(ValueError):
        resampling.resample(docs, target, 101)


def test_brackets_hold_the_cutoff(spark):
    scores = spark.range(20_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 77L ELSE (id * 7919) % 10007 END").alias("score")).repartition(9)
    ordered = sorted((r["score"] for r in scores.collect()), reverse=True)
    for wanted in (1, 7, 2_000, 13_300, 19_999, 20_000):
        for margin in (0.004, 1e-7):
            low, high, above = resampling.bracket(scores, 20_000, wanted, margin, 200)
            assert low <= ordered[wanted - 1] <= high and above == sum(s > high for s in ordered) < wanted
