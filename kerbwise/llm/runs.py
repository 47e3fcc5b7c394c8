"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no
neighbouring word extends; it counts with ``LEAST_LENGTH`` words and ``EXPONENT`` periods or more.

Many texts are one string of word numbers with an end mark of its own after each text, so that a few
numpy passes serve a whole slice:

1. the suffix array by doubling, in which only suffixes that are still equal are sorted again. Where no
   four words of a text occur twice, no two of its suffixes share the five words that a run's do, and the text
   is done;
2. longest common prefixes: positions whose preceding words differ are compared word by word, the others
   have one less than their predecessor;
3. each LCP interval of depth d and all its children but the largest: for suffix i of such a child, i + d and i - d
   are looked up in the inverse suffix array. If one lies in the interval, but in another child, a square
   of period d starts at the smaller of the two and cannot be moved to the right;
4. squares rotate to the left as far as words agree, galloping; squares that end at one place merge where a
   smaller period covers and divides them. What is left are the runs, once each.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words and no runs; equal or repeated rows are treated alike, each on its own; an
empty table gives an empty result; other columns are ignored. Whole texts are processed: a
worker holds some 200 bytes for each word of its slice (1 MB of text, or one longer text), so a
text of 5 million words takes a worker of 1 GB.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kerbwise.llm.ragged import gather
from kerbwise.llm.words import slices, utf8

LEAST_LENGTH, EXPONENT = 6, 4
_SLICE_BYTES = 1 << 20
_CHUNK = 1 << 21

REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
FOUND = REPORT + ", runs array<struct<start:long,length:long,period:long>>, collapsed string"


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the number of each word of all rows, and the ``rows + 1`` offsets of the rows."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    held = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(held)))[ends]
    coded = flat.filter(pa.array(held)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets


def joined(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One string of all rows: a mark, then each row and a mark; no two marks are equal, nor words of two rows."""
    counts = np.diff(offsets)
    width = np.int64(symbols.max(initial=0) + 2)
    out = np.full(len(symbols) + len(counts) + 1, -1, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    out[1 + np.arange(len(symbols)) + row] = row * width + symbols
    out[1 + offsets[1:] + np.arange(len(counts))] = np.arange(1, len(counts) + 1) * width - 1
    return out


def suffix_array(string: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string whose suffixes all differ, and the rows in which four symbols occur twice."""
    n = len(string)
    order = np.argsort(string, kind="stable")
    active, keys = np.arange(n), string[order]
    rank = np.empty(n, np.int64)
    shared, rows = 1, np.zeros(0, np.int64)
    while True:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[order[active]] = active[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        active = active[~(new & np.append(new[1:], True))]
        if shared == 4:
            rows = np.unique(row_of[order[active]])
        if not len(active):
            return order, rows
        at = order[active]
        keys = rank[at] * n + rank[at + shared]
        by = np.argsort(keys, kind="stable")
        order[active], keys = at[by], keys[by]
        shared *= 2


def agreeing(string: np.ndarray, left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """How many symbols agree from ``left`` and ``right`` on (``step`` 1) or backwards (-1).

    The widths compared double, so the work stays in proportion to what agrees. Marks end every comparison.
    """
    out = np.zeros(len(left), np.int64)
    todo, width, last = np.arange(len(left)), 4, len(string) - 1
    while len(todo):
        along = step * np.arange(width)
        rest = []
        for some in np.array_split(todo, max(1, -(-len(todo) * width // _CHUNK))):
            a, b = (np.clip((x[some] + step * out[some])[:, None] + along, 0, last) for x in (left, right))
            differ = string[a] != string[b]
            ended = differ.any(axis=1)
            out[some] += np.where(ended, differ.argmax(axis=1), width)
            rest.append(some[~ended])
        todo, width = np.concatenate(rest), min(2 * width, 4096)
    return out


def common_prefixes(string: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it; -1 at both ends."""
    n = len(string)
    before = np.zeros(n, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    fresh = (place == 0) | (place == order[0]) | (before == 0)
    fresh[1:] |= string[place[1:] - 1] != string[before[1:] - 1]
    fresh[1:] |= place[:-1] == order[0]
    at = np.flatnonzero(fresh & (place != order[0]))
    found = np.zeros(n, np.int64)
    found[at] = agreeing(string, at, before[at], 1)
    source = np.maximum.accumulate(np.where(fresh, place, 0))
    prefix = found[source] - (place - source)
    return np.concatenate(([-1], prefix[order[1:]], [-1]))


def smaller_before(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of ``at`` the nearest earlier place with a smaller value; there must be one.

    Minima of blocks of 2, 4, 8 ... places are climbed until one is smaller, then descended.
    """
    levels = [values]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append(np.minimum(x[0::2], np.append(x[1::2], np.iinfo(np.int64).max if len(x) % 2 else []).astype(np.int64)))
    wanted, x, height = values[at], at - 1, np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    for level, least in enumerate(levels):
        todo = todo[least[x[todo]] >= wanted[todo]]
        if not len(todo):
            break
        height[todo] = level + 1
        x[todo] = (x[todo] - 1) >> 1
    for level in range(int(height.max(initial=0)), 0, -1):
        some = np.flatnonzero(height >= level)
        least, child = levels[level - 1], 2 * x[some] + 1
        right = child < len(least)
        right[right] = least[child[right]] < wanted[some[right]]
        x[some] = child - ~right
    return x


def squares(order: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the squares that branch: the word after them differs from that one period earlier."""
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    cut = np.flatnonzero(prefix > 0)
    low = smaller_before(prefix, cut)
    high = n - smaller_before(prefix[::-1], n - cut)  # one past the interval
    by = np.argsort(low * (n + 1) + high, kind="stable")
    cut, low, high = cut[by], low[by], high[by]
    first = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[: len(cut)]
    group, heads = np.cumsum(first) - 1, np.flatnonzero(first)
    following = np.append(cut[1:], 0)[: len(cut)]
    ends = np.where(np.append(first[1:], True)[: len(cut)], high, following)
    # children: one before the first cut of an interval, one after each cut
    starts, ends = np.concatenate((low[heads], cut)), np.concatenate((cut[heads], ends))
    group = np.concatenate((np.arange(len(heads)), group))
    key = (ends - starts) * len(starts) + np.arange(len(starts))
    largest = np.full(len(heads), -1, np.int64)
    np.maximum.at(largest, group, key)
    small = np.flatnonzero(key != largest[group])
    depth = prefix[cut[heads]]
    found = []
    total = np.cumsum(ends[small] - starts[small])
    for some in np.split(small, np.searchsorted(total, np.arange(_CHUNK, total[-1] if len(total) else 0, _CHUNK))):
        size = ends[some] - starts[some]
        child = np.repeat(some, size)
        i = order[gather(np.arange(n), starts[some], size)]
        g = group[child]
        for sign in (1, -1):
            j = i + sign * depth[g]
            rank = inverse[np.clip(j, 0, n - 1)]
            hit = (j >= 0) & (j < n) & (rank >= low[heads][g]) & (rank < high[heads][g])
            hit &= (rank < starts[child]) | (rank >= ends[child])
            found.append((np.minimum(i, j)[hit], depth[g][hit]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def merged(string: np.ndarray, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of branching squares: start, length and smallest period of each.

    Of the squares that end at one place the smallest rotates to the left; its run holds all whose period
    it divides and which it covers. The rest go into the next of at most log n rounds.
    """
    n = len(string)
    key = np.unique((start + 2 * period) * (n + 1) + period)
    end, period = key // (n + 1), key % (n + 1)
    runs = [(np.zeros(0, np.int64),) * 3]
    while len(end):
        first = np.concatenate(([True], end[1:] != end[:-1]))
        least, stop = period[first], end[first]
        left = stop - 2 * least
        begin = left - agreeing(string, left - 1, left - 1 + least, -1)
        runs.append((begin, stop - begin, least))
        of = np.cumsum(first) - 1
        same = (period % least[of] == 0) & (end - 2 * period >= begin[of])
        end, period = end[~first & ~same], period[~first & ~same]
    return tuple(np.concatenate(x) for x in zip(*runs))


def runs_of(symbols: np.ndarray, offsets: np.ndarray, least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """Row, start, length and period of every run, by row, start and period; symbols are numbers from 0.

    ``(exponent - 1) * period`` and ``least - 1`` must be 5 or more where they meet, as with the defaults.
    """
    string = joined(symbols, offsets)
    row_of = np.concatenate(([-1], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 1)))
    order, rows = suffix_array(string, row_of)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 4
    held = np.zeros(len(offsets), bool)
    held[rows] = True
    held[-1] = True  # the mark before the first row
    mask = held[row_of]
    place = np.cumsum(mask) - 1
    string, row_of, order = string[mask], row_of[mask], place[order[mask[order]]]
    start, length, period = merged(string, *squares(order, common_prefixes(string, order)))
    kept = length >= np.maximum(least, exponent * period)
    start, length, period = start[kept], length[kept], period[kept]
    row = row_of[start]
    start = start - np.searchsorted(row_of, row)
    by = np.lexsort((period, start, row))
    return row[by], start[by], length[by], period[by]


def planted(doc_ids: list, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The word numbers after the repeats of the registered query: one row in ten gets a stretch that repeats to its end.

    A row without an id is left as it is.
    """
    out = symbols.copy()
    for doc_id, a, b in zip(doc_ids, offsets[:-1].tolist(), offsets[1:].tolist()):
        n = b - a
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            at = g % n
            p = 1 + (n - at) // (3 + g % 8)
            out[a + at:b] = symbols[a + at + np.arange(n - at) % p]
    return out


def _rows(doc_ids: list, texts: pa.Array, plant: bool, full: bool) -> pa.RecordBatch:
    words, symbols, offsets = split(texts)
    if plant:
        symbols = planted(doc_ids, symbols, offsets)
    rows = len(offsets) - 1
    row, start, length, period = runs_of(symbols, offsets)
    dropped = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(dropped, offsets[row] + start + period, 1)
    np.add.at(dropped, offsets[row] + start + length, -1)
    kept = np.cumsum(dropped)[:-1] == 0
    ends = np.concatenate(([0], np.cumsum(kept)))[offsets]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(symbols[kept])))
    data, at = utf8(pc.binary_join(lists, pa.scalar(" ", pa.large_string())))
    collapsed = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    counts = np.bincount(row, minlength=rows)
    best = np.lexsort((period, start, -(length / np.maximum(period, 1)), row))
    best = best[np.concatenate(([True], row[best][1:] != row[best][:-1]))[: len(best)]]
    columns = {"start": start, "length": length, "period": period, "exponent_milli": 1000 * length // np.maximum(period, 1)}
    out = {"doc_id": pa.array(doc_ids, pa.int64()), "n_runs": pa.array(counts.astype(np.int64))}
    for name, values in columns.items():
        column, none = np.zeros(rows, np.int64), counts == 0
        column[row[best]] = values[best]
        out[name] = pa.array(column, mask=none)
    spelled = list(map("{},{},{}\n".format, start.tolist(), length.tolist(), period.tolist()))
    bounds = np.concatenate(([0], np.cumsum(counts))).tolist()
    none = hashlib.sha256(b"").hexdigest()
    out["runs_sha256"] = pa.array(
        [hashlib.sha256("".join(spelled[a:b]).encode()).hexdigest() if a < b else none for a, b in zip(bounds, bounds[1:])], pa.string()
    )
    out["collapsed_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in collapsed], pa.string())
    if full:
        triples = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
        out["runs"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), triples)
        out["collapsed"] = pa.array([x.decode() for x in collapsed], pa.string())
    return pa.record_batch(out)


def _scan(plant: bool, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").cast(pa.int64()).to_pylist()
            for a, b in slices(batch.num_rows, np.diff(utf8(texts)[1]), _SLICE_BYTES):
                yield _rows(ids[a:b], texts.slice(a, b - a), plant, full)

    return run


def scan(docs: DataFrame, plant: bool = False, full: bool = False) -> DataFrame:
    """Per row: number of runs, the run of greatest exponent, digests of all runs and of the text with each run cut to one period.

    ``full`` adds the runs and the collapsed text themselves; ``plant`` first gives one row in ten a repeating end
    (:func:`planted`). Ties of the exponent go to the smallest start, then period. No shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(plant, full), FOUND if full else REPORT)
