"""Text columns as flat byte buffers, so that numpy handles many documents in one step.

Every function works on slices of a quarter of a megabyte: whole documents, as many as fit,
and at least one. Memory is therefore bounded by the slice or by the longest single document,
of which words and hashes are held (about 10 bytes for each byte of text), never an array of
64-bit numbers for its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices (first row, bytes, row offsets) of a string column; null is empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least ``n`` of each; kept up to a slice."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    tables = []
    for base in (BASE, INVERSE):
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps))
    if n <= SLICE_BYTES + 1:
        _powers[:] = tables
    return tables[0], tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash of the bytes of each span; equal bytes give equal hashes.

    Spans are ascending and do not overlap. Differences of running sums, taken a slice of
    bytes at a time: a sum carries over, relative to the first byte of its slice.
    """
    size = SLICE_BYTES
    up, down = powers(min(len(data), size) + 1)
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(data), size):
        part = data[at : at + size]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        a, b = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
        if a >= b:
            continue
        here = np.arange(a, b)
        low = np.maximum(starts[here] - at, 0)
        own = sums[np.minimum(ends[here] - at, len(part))] - sums[low]
        # seen from the start of the span: earlier slices are a whole number of slices behind
        behind = np.maximum(at - starts[here], 0)
        own = own * down[low]
        for k in np.flatnonzero(behind):  # at most the one span that reaches in from before
            own[k : k + 1] *= np.uint64(pow(int(BASE), int(behind[k]), 1 << 64))
        out[here] += own
    return mix(out)


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple:
    """Starts and ends of the words of all rows, and the first word of each row (one more at the end)."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[filled] = inside[filled]
    ends_at = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends_at] = inside[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rows_of(pointers: np.ndarray) -> np.ndarray:
    """The row of each element, from the row pointers."""
    return np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive words from each place on; rows are not told apart."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + words[k : k + len(h)]
    return mix(h)


def inside_rows(pointers: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of ``count`` grams of ``n`` elements stay inside one row."""
    ok = np.ones(count, bool)
    for k in range(1, n):
        crossed = pointers[1:-1] - k
        ok[crossed[(crossed >= 0) & (crossed < count)]] = False
    return ok


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[0].., starts[1].., each ``counts`` long, one after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)
