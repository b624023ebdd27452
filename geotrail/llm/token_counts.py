"""Operator 1, token counts by offset-mapped attribution.

A document is encoded once, as a whole. The character span of every token is then joined
with the spans of the document's sections (its lines, or spans given in a column), and a
token that crosses a boundary goes to the section that holds most of its bytes, the earlier
one if it is a tie. A line owns the line break that ends it.

Defined results: a null or empty text has no sections and gives no row (with given spans,
spans are cut to the text and count 0). Null spans are none. Repeated rows are counted
each. Columns besides the named ones are not read; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.encoding import ENCODED_BYTES, column_of, encoder, tokenizer_path
from geotrail.llm.textbuf import rows_of, text_slices

SCHEMA = "section int, char_start long, char_end long, n_tokens long, n_crossing long"


def line_spans(data: np.ndarray) -> np.ndarray:
    """Byte spans of the lines of one text, each with its line break."""
    breaks = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(breaks) or breaks[-1] != len(data)):
        breaks = np.append(breaks, len(data))
    return np.stack([np.concatenate([[0], breaks[:-1]]), breaks], 1).astype(np.int64) if len(breaks) else np.zeros((0, 2), np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each span, and how many of them cross its edge into another span.

    ``starts`` and ``ends`` are the byte spans of the tokens, in order and without gaps;
    ``spans`` are sorted and do not overlap. The join is a binary search of both ends.
    """
    counts, crossing = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
    if not len(spans) or not len(starts):
        return counts, crossing
    first = np.searchsorted(spans[:, 1], starts, "right")
    last = np.searchsorted(spans[:, 0], ends, "left") - 1
    one = first == last
    counts += np.bincount(first[one], minlength=len(spans))
    for t in np.flatnonzero(last > first):
        touched = np.arange(first[t], last[t] + 1)
        held = np.minimum(spans[touched, 1], ends[t]) - np.maximum(spans[touched, 0], starts[t])
        winner = touched[np.argmax(held)]
        counts[winner] += 1
        crossing[winner] += np.count_nonzero(held > 0) > 1
    return counts, crossing


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    spans: str | None = None,
    tokenizer: str = "byte_bpe_50k.json",
) -> DataFrame:
    """Tokens of each section of each document: doc_id, section, char_start, char_end, n_tokens, n_crossing.

    ``spans`` may name a column array<struct<start, end>> of characters, sorted and disjoint.
    """
    path = tokenizer_path(tokenizer)
    chosen = [F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")]
    if spans:
        pair = lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))
        chosen.append(F.transform(F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull()), pair).alias("spans"))
    rows = docs.select(*chosen)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids, given = column_of(batch, "doc_id"), column_of(batch, "spans") if spans else None
            for row, data, offsets in text_slices(column_of(batch, "text"), ENCODED_BYTES):
                tokens, pointers = coder.encode(data, offsets)
                ends = np.cumsum(coder.token_bytes[tokens])
                starts = ends - coder.token_bytes[tokens]
                # characters before each byte, counted over the slice
                before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                whose, found = [], []
                for k in range(len(offsets) - 1):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    if given is None:
                        place = line_spans(data[a:b]) + a
                    else:
                        wanted = np.array([(s["start"], s["end"]) for s in given[row + k].as_py() or []], np.int64).reshape(-1, 2)
                        place = np.searchsorted(before[: b + 1], np.clip(wanted, 0, before[b] - before[a]) + before[a], "left")
                        place = np.maximum(place, a)
                    tok = slice(pointers[k], pointers[k + 1])
                    counts, crossing = attribute(starts[tok], ends[tok], place)
                    whose.append(len(place))
                    found.append(np.column_stack([np.arange(len(place)), before[place] - before[a], counts, crossing]))
                if not sum(whose):
                    continue
                table = np.concatenate(found)
                owner = row + rows_of(np.concatenate([[0], np.cumsum(whose)]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), pa.array(table[:, 0].astype(np.int32))] + [pa.array(table[:, c]) for c in range(1, 5)],
                    names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
