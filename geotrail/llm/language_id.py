"""Operator 2, language identification by partial matching.

For every language a tree of byte contexts of up to ``order`` bytes is learned from a
bounded sample: the counts of the bytes that follow each context. A byte is coded in the
longest known context; if it never followed there, an escape is coded and the next shorter
context is asked without the bytes already ruled out (escape method C with exclusions),
down to a uniform choice. The statistics are frozen, so the code length of a byte is a
function of its context alone: it is tabulated for all contexts, bytes and languages, and
the exact code length of a text is a sum of table entries. The shortest code wins; the
score is the posterior of that language among all learned ones.

Defined results: null text, or text without a letter, is ``und`` with score 0, and so is
everything if nothing could be learned; ties go to the name that sorts first; repeated
rows get equal answers; labels that are null and texts that are null teach nothing; kept
columns named like an added one are replaced by it.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.encoding import kept_columns
from geotrail.llm.sampling import bounded_sample
from geotrail.llm.textbuf import text_slices

UNKNOWN = "und"
ORDER = 4
SAMPLE_DOCS = 800
SAMPLE_CHARS = 3_000_000
"""Learned from, of each language: so many documents and characters at most, whole texts only."""
MAX_CONTEXTS = 4_000
"""Contexts kept of each language, the most frequent ones."""
MIN_COUNT = 4
MAX_LANGUAGES = 64
"""Languages learned, those with the most rows: a bound on what a column of wild labels can make of a model."""


def count_contexts(texts: list[bytes], order: int, max_contexts: int, min_count: int) -> pd.DataFrame:
    """Counts of the bytes after each kept context: n, context, symbol, count. Contexts are big-endian numbers."""
    gap = b"\0" * order
    data = np.frombuffer(gap + gap.join(texts), np.uint8).astype(np.int64)
    real = np.ones(len(data), bool)
    at = order
    real[:order] = False
    for t in texts:
        at += len(t)
        real[at : at + order] = False
        at += order
    place = np.flatnonzero(real)
    parts = []
    for n in range(order + 1):
        value = np.zeros(len(place), np.int64)
        for back in range(n, -1, -1):
            value = (value << 8) | data[place - back]
        grams, counts = np.unique(value, return_counts=True)
        parts.append(pd.DataFrame({"n": n, "context": grams >> 8, "symbol": grams & 255, "count": counts}))
    found = pd.concat(parts)
    totals = found.groupby(["n", "context"], as_index=False)["count"].sum()
    totals = totals[(totals["count"] >= min_count) | (totals["n"] == 0)]
    totals = totals.sort_values(["count", "n", "context"], ascending=[False, True, True]).head(max_contexts)
    return found.merge(totals[["n", "context"]], on=["n", "context"])


@dataclass
class ContextModel:
    """Frozen statistics of all languages as tables."""

    languages: list[str]
    order: int
    symbol: np.ndarray
    """Symbol of each byte; 0 for bytes never seen."""
    child: np.ndarray
    """Node of the context that a node and one earlier byte make; the last node has none."""
    bits: np.ndarray
    """Code length: a row for each node and symbol, a column for each language."""

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every row of a slice under every language."""
        if not self.languages:
            return np.zeros((len(offsets) - 1, 0))
        gap, rows = self.order, len(offsets) - 1
        where = np.arange(len(data)) + gap * np.repeat(np.arange(1, rows + 1), np.diff(offsets))
        symbols = np.full(len(data) + gap * (rows + 1), self.symbol[0], np.int32)
        symbols[where] = self.symbol[data]
        width, dead = self.child.shape[1], len(self.child) - 1
        flat = self.child.ravel()
        node = np.zeros(len(data), np.int32)
        deepest = node
        for back in range(1, self.order + 1):
            node = flat[node * width + symbols[where - back]]
            deepest = np.where(node == dead, deepest, node)
        costs = self.bits.take(deepest * width + symbols[where], axis=0)
        out = np.zeros((rows, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(costs, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def build_model(counts: pd.DataFrame, order: int) -> ContextModel:
    """Tables from the counts (lang, n, context, symbol, count) of all languages."""
    languages = sorted(counts["lang"].unique())
    seen = sorted({0, *counts["symbol"].unique()})
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    tables: dict[str, dict] = {}
    for lang, own in counts.groupby("lang"):
        table: dict[tuple[int, int], np.ndarray] = {}
        for (n, context), part in own.groupby(["n", "context"]):
            row = np.zeros(width)
            row[symbol[part["symbol"]]] = part["count"]
            table[n, context] = row
        tables[lang] = table
    nodes = {(0, 0): 0}
    for key in sorted({key for table in tables.values() for key in table}):
        if key[0] and (key[0] - 1, key[1] & ((1 << 8 * (key[0] - 1)) - 1)) in nodes:
            nodes[key] = len(nodes)
    child = np.full((len(nodes) + 1, width), len(nodes), np.int32)
    bits = np.zeros((len(nodes) * width, len(languages)), np.float32)
    for (n, context), k in nodes.items():
        if n:
            child[nodes[n - 1, context & ((1 << 8 * (n - 1)) - 1)], symbol[context >> 8 * (n - 1)]] = k
    for column, lang in enumerate(languages):
        done: dict[tuple[int, int], np.ndarray] = {}
        for (n, context), k in nodes.items():
            chain = [(m, context & ((1 << 8 * m) - 1)) for m in range(n, -1, -1)]
            chain = [key for key in chain if key in tables[lang]]
            if chain and chain[0] not in done:
                done[chain[0]] = _code_lengths([tables[lang][key] for key in chain], width)
            bits[k * width : (k + 1) * width, column] = done[chain[0]] if chain else np.log2(256)
    return ContextModel(languages, order, symbol, child, bits)


def _code_lengths(chain: list[np.ndarray], width: int) -> np.ndarray:
    """Bits of every symbol, longest context first."""
    out, ruled_out, spent = np.zeros(width), np.zeros(width, bool), 0.0
    for counts in chain:
        here = (counts > 0) & ~ruled_out
        kinds = np.count_nonzero(here)
        if not kinds:
            continue
        total = counts[here].sum() + kinds
        out[here] = spent - np.log2(counts[here] / total)
        spent -= np.log2(kinds / total)
        ruled_out |= here
    out[~ruled_out] = spent + np.log2(max(1, 256 - np.count_nonzero(ruled_out)))
    return out


@dataclass(frozen=True)
class PackedModel:
    """A learned model as it travels; every worker unpacks it once.

    Most contexts of a node are unknown to most languages, which then code as in a shorter
    one: only the different rows of a language are kept, and which row each node has.
    """

    languages: list[str]
    packed: bytes


def pack(model: ContextModel) -> bytes:
    width, rows = model.child.shape[1], []
    for column in range(len(model.languages)):
        distinct, which = np.unique(model.bits[:, column].reshape(-1, width), axis=0, return_inverse=True)
        rows.append((distinct, which.astype(np.int32).ravel()))
    return zlib.compress(pickle.dumps((model.languages, model.order, model.symbol, model.child, rows)), 1)


_unpacked: dict[bytes, ContextModel] = {}


def unpack(model: PackedModel) -> ContextModel:
    """The tables of a model; a worker keeps those it used last."""
    if model.packed not in _unpacked:
        _unpacked.clear()
        languages, order, symbol, child, rows = pickle.loads(zlib.decompress(model.packed))
        bits = np.empty((len(rows[0][1]) * child.shape[1], len(languages)), np.float32)
        for column, (distinct, which) in enumerate(rows):
            bits[:, column] = distinct[which].ravel()
        _unpacked[model.packed] = ContextModel(languages, order, symbol, child, bits)
    return _unpacked[model.packed]


def train(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    order: int = ORDER,
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
    max_contexts: int = MAX_CONTEXTS,
    max_languages: int = MAX_LANGUAGES,
) -> PackedModel:
    """Learn from rows with text and language. ``key`` only orders the bounded sample.

    Contexts are counted in a task for each language, and the tables made in one; the
    driver passes the packed model on.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("key"))
    sample = bounded_sample(rows, "lang", F.col("key"), sample_docs, sample_chars, F.length("text"), max_languages)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        out = count_contexts([t.encode() for t in part["text"]], order, max_contexts, MIN_COUNT)
        return out.assign(lang=part["lang"].iloc[0])[["lang", "n", "context", "symbol", "count"]]

    def build(part: pd.DataFrame) -> pd.DataFrame:
        model = build_model(part, order)
        return pd.DataFrame({"languages": [model.languages], "packed": [pack(model)]})

    counts = sample.groupBy("lang").applyInPandas(count, "lang string, n int, context long, symbol int, count long")
    made = counts.groupBy(F.lit(0).alias("all")).applyInPandas(build, "languages array<string>, packed binary").collect()
    return PackedModel(list(made[0]["languages"]), bytes(made[0]["packed"])) if made else PackedModel([], b"")


def predict(docs: DataFrame, model: PackedModel, text: str = "text", keep: list[Column | str] | None = None) -> DataFrame:
    """``keep`` columns with lang_pred, score and bits, the code length of the winner."""
    shared, model_languages = docs.sparkSession.sparkContext.broadcast(model), model.languages

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = unpack(shared.value) if model_languages else None
        names = np.array([*model_languages, UNKNOWN], object)
        for texts in batches:
            void = texts.is_null().to_numpy(zero_copy_only=False)
            lang, score, bits = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
            for _, data, offsets in text_slices(texts):
                lengths = known.code_lengths(data, offsets) if known else np.zeros((len(offsets) - 1, 1))
                best = lengths.argmin(1)
                least = lengths[np.arange(len(best)), best]
                lang.append(best)
                bits.append(least)
                score.append(1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1))
            none = void | (known is None)
            at = np.where(none, len(names) - 1, np.concatenate(lang))
            numbers = [pa.array(np.where(none, 0.0, np.concatenate(part))) for part in (score, bits)]
            yield pa.StructArray.from_arrays([pa.array(names[at], pa.string()), *numbers], ["lang_pred", "score", "bits"])

    # only the texts go to Python; the other columns wait in the JVM
    guess = F.arrow_udf(run, "lang_pred string, score double, bits double").asNondeterministic()
    texts = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    kept = F.struct(*kept_columns(docs, keep, ["lang_pred", "score", "bits"])).alias("kept")
    return docs.select(kept, guess(texts).alias("found")).select("kept.*", "found.*")
