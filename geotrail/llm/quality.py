"""Operator 10, quality by supervised subword embeddings.

A document is the average of the learned vectors of its hashed features: words, pairs of
words (a word said twice running is one feature, whatever the word), and the 3 to 5 byte
strings inside words, word edges included. A softmax of two
classes reads the average. Vectors and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled documents, in one task.

Since the average is linear, vectors and softmax fold into one number for each bucket (the
difference of the two logits); a text is scored by summing these, every feature of the
whole text included.

Defined results: null and empty texts have no features and get the score of the learned
bias; without any label every score is 0.5; repeated rows get equal scores; rows whose
label is null teach nothing; a kept column named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.llm.encoding import column_of, kept_columns
from geotrail.llm.sampling import bounded_sample
from geotrail.llm.textbuf import BASE, SPACES, find_words, mix, rows_of, span_hashes, text_slices

BUCKET_BITS = 20
SAMPLE_DOCS = 2_500
SAMPLE_CHARS = 12_000_000
"""Learned from, of each label: so many documents and characters at most, whole texts only."""
DIM = 16
STEPS = 15_000
"""Steps of the descent, however many documents there are: small samples are passed over more often."""
RATE = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of a slice and their rows, one kind of feature at a time."""
    shift = np.uint64(64 - BUCKET_BITS)
    starts, ends, pointers = find_words(data, offsets)
    words = span_hashes(data, starts, ends)
    owner = rows_of(pointers) if len(starts) else np.zeros(0, np.int64)
    yield (words >> shift).astype(np.int64), owner
    if len(words) > 1:
        pairs = mix(words[:-1] * BASE + words[1:])
        pairs[words[:-1] == words[1:]] = BASE  # any word said twice running is one feature
        same = owner[:-1] == owner[1:]
        yield (pairs[same] >> shift).astype(np.int64), owner[:-1][same]
    space = SPACES[data]
    plain = np.where(space, np.uint8(32), data).astype(np.uint64)
    row = rows_of(offsets)
    gram, ok = plain, np.ones(len(data), bool)
    for n in range(2, 6):
        if len(data) < n:
            return
        count = len(data) - n + 1
        gram = gram[:count] | (plain[n - 1 :] << np.uint64(8 * (n - 1)))
        ok = ok[:count] & (row[:count] == row[n - 1 :])
        if n > 2:
            ok &= ~space[n - 2 : n - 2 + count]
            at = np.flatnonzero(ok)
            yield (((gram[at] + np.uint64(n << 56)) * BASE) >> shift).astype(np.int64), row[at]


@dataclass
class QualityModel:
    """Folded logits: one for each bucket, and the bias."""

    logit: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, count = np.zeros(rows), np.zeros(rows)
        for bucket, owner in features(data, offsets):
            total += np.bincount(owner, self.logit[bucket], rows)
            count += np.bincount(owner, minlength=rows)
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(count, 1))))


def fit(texts: list[str], labels: np.ndarray, dim: int, steps: int, rate: float, seed: int) -> QualityModel:
    """Stochastic gradient descent, one document a step, with a falling rate."""
    documents = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        buckets = [b for b, _ in features(raw, np.array([0, len(raw)], np.int64))] if len(raw) else []
        ids, counts = np.unique(np.concatenate(buckets), return_counts=True) if buckets else (np.zeros(0, int), np.zeros(0))
        documents.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    head, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    done, steps = 0, max(steps, len(documents))
    while done < steps and documents:
        for k in rng.permutation(len(documents))[: steps - done]:
            ids, weight = documents[k]
            pace, done = rate * (1 - done / steps), done + 1
            own = vectors[ids]
            mean = weight @ own
            logits = mean @ head + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[k]] -= 1
            pull = head @ error
            head -= pace * np.outer(mean, error)
            bias -= 0.01 * pace * error
            vectors[ids] = own - pace * weight[:, None] * pull
    contrast = head[:, 1] - head[:, 0]
    return QualityModel(vectors @ contrast, float(bias[1] - bias[0]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "quality",
    key: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
    dim: int = DIM,
    steps: int = STEPS,
    rate: float = RATE,
    seed: int = 7,
) -> QualityModel:
    """Learn from texts of ``docs`` and 0/1 labels of ``labels``, both with ``key``.

    The sample is drawn from the labels alone, so its ids have a fixed bound and are
    broadcast; the texts are not shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    drawn = bounded_sample(known, "label", F.col("key"), sample_docs, sample_docs, F.lit(1))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(drawn), "key")
    # texts above the bound come last, so they cost no other text its place; the smallest is taken if there is no other
    above = F.greatest(F.length("text"), F.lit(sample_chars))
    order = Window.partitionBy("label").orderBy(above, F.xxhash64("key"), "key", "text").rowsBetween(Window.unboundedPreceding, 0)
    sample = rows.withColumns({"n": F.row_number().over(order), "chars": F.sum(F.length("text")).over(order)})
    sample = sample.where((F.col("n") <= sample_docs) & ((F.col("chars") <= sample_chars) | (F.col("n") == 1))).select("key", "label", "text")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "label", "text"])
        model = fit(list(part["text"]), part["label"].to_numpy(), dim, steps, rate, seed)
        return pd.DataFrame({"logit": [model.logit.astype(np.float32).tobytes()], "bias": [model.bias]})

    learned = sample.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "logit binary, bias double").collect()
    if not learned:
        return QualityModel(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    return QualityModel(np.frombuffer(learned[0]["logit"], np.float32), learned[0]["bias"])


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[Column | str] | None = None) -> DataFrame:
    """``keep`` columns with the score of every whole text, higher if label 1 is likelier."""
    chosen = docs.select(F.struct(*kept_columns(docs, keep, ["score"])).alias("kept"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            parts = [known.score(data, offsets) for _, data, offsets in text_slices(column_of(batch, "text"))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([column_of(batch, "kept"), pa.array(scores)], names=["kept", "score"])

    struct = chosen.schema["kept"].dataType.simpleString()
    return chosen.mapInArrow(run, f"kept {struct}, score double").select("kept.*", "score")
