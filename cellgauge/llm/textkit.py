"""Words and hashes of whole batches of texts, in numpy.

A batch's texts lie end to end in one byte buffer; every function works on the buffer,
not text by text.  Work goes in slices of bounded bytes (a longer text is a slice of its
own), so memory follows the slice or the longest text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudorandom numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03))


BYTE_KEY = keys64(256, 11)
FACTOR = int(keys64(1, 12)[0]) | 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR**i and FACTOR**-i modulo 2**64."""
    out = []
    for base in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE_BYTES * 2
    while size < n:
        size *= 2
    return _powers(size)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about ``most`` bytes."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, a run without bytes of ``gaps``; no word crosses texts."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    space = gaps[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums of a polynomial over the buffer."""
    up, down = powers(len(data) + 1)
    table = BYTE_KEY[fold] if fold is not None else BYTE_KEY
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


SHINGLE_KEYS = keys64(64, 13) | np.uint64(1)


def shingle_hashes(words: np.ndarray, owner: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words, text after text, and offsets per text.  A text of fewer words has one: the whole."""
    counts = np.bincount(owner, minlength=texts)
    first = np.concatenate(([0], np.cumsum(counts)))
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(made)))
    total = int(offsets[-1])
    text = np.repeat(np.arange(texts), made)
    at = np.arange(total) - offsets[text] + first[text]
    size = np.minimum(counts, k)[text]
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    out = size.astype(np.uint64) * SHINGLE_KEYS[k]
    for i in range(k):
        out += np.where(i < size, padded[at + i] * SHINGLE_KEYS[i], np.uint64(0))
    return mix64(out), offsets
