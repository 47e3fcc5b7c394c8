"""Words, word hashes and shingle hashes of whole Arrow string columns with numpy.

All functions work on the UTF-8 bytes of a column at once, so a batch costs a few vector
passes however its bytes are divided into documents. A word hash is 64 bits wide.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes that end a word written as ``[^\\x20\\x09-\\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes outside ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased.
MARKS = np.zeros(256, bool)
MARKS[:0x30] = MARKS[0x3A:0x41] = MARKS[0x5B:0x61] = MARKS[0x7B:0x80] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the ``rows + 1`` offsets of its rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words(data: np.ndarray, offsets: np.ndarray, stops: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the ``rows + 1`` word offsets of the rows."""
    inside = ~stops[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word never runs on into the next row
    before = np.concatenate(([False], inside))[: len(data)]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))[: len(data)]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of integers: a polynomial, scrambled."""
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(len(values), _BASE), out=running[1:], dtype=np.uint64)
    shift = _powers(len(values) + 1, _INVERSE)
    return mixed((running[ends] - running[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes, A-Z as a-z if ``lower``."""
    return range_hashes(_LOWER[data] if lower else data, starts, ends)


def hash_of(word: str) -> np.uint64:
    """The hash that :func:`hashes` gives a word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return hashes(data, np.array([0]), np.array([len(data)]))[0]


def shingles(word_hashes: np.ndarray, word_offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words and the row offsets; a row of 1 to k-1 words is one shingle."""
    counts = np.diff(word_offsets)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate(([0], np.cumsum(made)))
    row = np.repeat(np.arange(len(counts)), made)
    first = word_offsets[:-1][row] + (np.arange(offsets[-1]) - offsets[:-1][row])
    length = np.minimum(counts, k)[row]
    value = length.astype(np.uint64)
    for j in range(k):
        has = length > j
        word = word_hashes[np.where(has, first + j, 0)] if len(word_hashes) else np.zeros(len(first), np.uint64)
        value = np.where(has, mixed(value * _BASE + word), value)
    return value, offsets


def sorted_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The values with each row's own in ascending order."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[a:b].sort()
    return values


def unique_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, and their offsets."""
    values = sorted_by_row(values, offsets)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of fixed-width values as an Arrow column of little-endian bytes."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int64) * width)), pa.py_buffer(np.ascontiguousarray(values))],
    ).cast(pa.binary())


def slices(rows: int, lengths: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one longer row is a range of its own)."""
    out, start, total = [], 0, 0
    for i in range(rows):
        if i > start and total + lengths[i] > limit:
            out.append((start, i))
            start, total = i, 0
        total += int(lengths[i])
    if rows > start:
        out.append((start, rows))
    return out


def lean(run: Callable) -> Callable:
    """``run`` (batches to batches), after which the worker gives freed memory back to the system.

    Workers outlive their tasks and would hold it idle beside the tasks of later stages.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped
