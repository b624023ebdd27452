"""Token ids of whole documents, each distinct piece of text encoded once.

A byte-level tokenizer of the given kind splits text before it merges, and never across
the place before a space or around a line break that a printing character follows. The
text is cut at those places; pieces are told apart by hash, new ones go through
``tokenizers`` and the ids of known ones are copied. The ids are those of one call for
the whole text.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.textbuf import SPACES, ragged, span_hashes

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
CACHE_PIECES = 1_000_000
"""Known pieces that a Python worker keeps; beyond it the store starts anew."""

ENCODED_BYTES = 1 << 20
"""Bytes of texts that are encoded at once; every call looks new pieces up among all known ones."""

# Lead bytes of characters that may be white space beyond ASCII: no cut before them.
_MAY_BE_SPACE = [0xC2, 0xE1, 0xE2, 0xE3]
_PRINTS = ~SPACES.copy()
_PRINTS[_MAY_BE_SPACE + list(range(32)) + [127]] = False
_LINE = np.zeros(256, bool)
_LINE[10] = True


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that the tokenizer never joins, row starts included."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        printing = _PRINTS[data[1:]]
        ends = offsets[(offsets > 0) & (offsets < len(data))] - 1
        printing[ends] = False  # what follows the last byte of a row is another text
        breaks = _LINE[data[:-1]] & printing
        cut[:-2] = ((data[:-1] == 32) & printing) | breaks
        cut[1:-1] |= breaks
    cut[offsets] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes slices of texts with a tokenizers file; keeps what it has encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, k in vocab.items():
            self.token_bytes[k] = len(token)
        for k, token in self.tokenizer.get_added_tokens_decoder().items():
            self.token_bytes[k] = len(token.content.encode())
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint16 if len(self.token_bytes) < 1 << 16 else np.uint32)
        self.used = 0

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        whole = data.tobytes()
        texts = [whole[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for at in range(0, len(texts), 50_000):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 50_000], add_special_tokens=False)]
            count = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((i for ids in coded for i in ids), np.int64, int(count.sum()))
            need = self.used + len(flat)
            if need > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(need, len(self.pool)), self.pool.dtype)])
            self.pool[self.used : need] = flat
            self.keys = np.concatenate([self.keys, keys[at : at + 50_000]])
            self.place = np.concatenate([self.place, self.used + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.used = need
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.place, self.count = self.keys[order], self.place[order], self.count[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a slice, and the pointers of the rows into them."""
        starts = cut_places(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        seen = at < len(self.keys)
        new[seen] = self.keys[at[seen]] != keys[seen]
        if new.any():
            self._learn(data, keys[new], starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.keys, keys)
        at = at[which]
        count = self.count[at]
        pointers = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(count, out=pointers[1:])
        ids = self.pool[ragged(self.place[at], count)]
        return ids, pointers[np.searchsorted(starts, offsets)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizers file; one for all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """A public tokenizer file by name; a path is taken as it is."""
    return name if os.path.sep in name else public_tokenizers.path(name)


def kept_columns(docs: DataFrame, keep: list[Column | str] | None, added: list[str]) -> list[Column | str]:
    """Columns to carry along; one that an added column would name again is replaced by it."""
    chosen = docs.select(*(keep if keep is not None else docs.columns))
    names = {c.lower() for c in added}
    kept = [c for c, name in zip(keep if keep is not None else docs.columns, chosen.columns, strict=True) if name.lower() not in names]
    return kept or [F.lit(None).cast("string").alias("_none")]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
