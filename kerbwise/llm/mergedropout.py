"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Merges are taken from an agenda, best score first and leftmost among equals. A candidate merge is
skipped for good when the keyed hash of (seed, document's key, the unit's place in it, the merge's place in
the unit) falls below the dropout rate. A unit is a run of white-space signs with the word behind it; no
piece reaches across units, so units are encoded by themselves. Which of a word's possible candidates are
dropped settles its pieces, so units with the same word and the same dropped candidates share a
result; the number of segmentations of a word has no bound. Candidates are listed, and results held, only for words and
results that come again. Units of a block go through their agendas together, one merge each per
numpy pass; those of more than 255 signs (in scripts without spaces, say) have a heap of their own.

Characters outside the vocabulary, and the white-space sign itself where a text holds it, are
spelled in byte pieces. Decoding returns the very same text. With rate 0 the ids are those of the
public library (except for texts with that sign).

A null or empty text has no ids. A null key counts as key 0. Repeated rows get equal ids. An empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbwise.llm.ragged import KeyedRows, Seen, gather
from kerbwise.llm.words import binaries, lean, mixed, range_hashes, slices, utf8

SPACE = 0x2581
RATE, SEED = 0.1, 20_240
_SLICE_BYTES = 2 << 20
#: Units of more signs share no results, and those of more than _HEAP signs have a heap of their own.
_LONG, _HEAP = 64, 255
_UNITS = 1 << 16
#: Symbols that go through their agendas together: few enough to stay in a processor's cache.
_SYMBOLS = 1 << 17
_SLOT_BITS = 21
_NONE = np.int64(1) << 62
_STEP = np.uint64(0xD6E8FEB86659FD93)

ENCODED = "doc_id long, ids binary"
REPORT = "doc_id long, n_ids long, ids_crc32 long, n_bytes long, lossless boolean"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Vocabulary and merge table of a BPE model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        ids = {t: i for i, t in text.items()}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for t, i in ids.items():
            if len(t) == 1:
                self.char_ids[ord(t)] = i
        order = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        merges = {}
        for i, t in text.items():
            for cut in range(1, len(t)):
                left, right = ids.get(t[:cut]), ids.get(t[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = (order[model.get_score(i)], i)
        self.longest = max(map(len, text.values()), default=1)
        keys = sorted(merges)
        self.merge_keys = np.array(keys, np.int64)
        self.merge_rank = np.array([merges[k][0] for k in keys], np.int64)
        self.merge_id = np.array([merges[k][1] for k in keys], np.int32)
        self.rank_of = merges
        self._index()
        spelled = [text[i].replace(chr(SPACE), " ").encode() if i in text else b"" for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            spelled[i] = bytes([b])
        self.lengths = np.array([len(b) for b in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def _index(self) -> None:
        """A hash table of the merges by their key: a byte each place that tells whether it is taken, and the merge there."""
        self.taken, self.merge_at = np.zeros(1 << _SLOT_BITS, bool), np.zeros(1 << _SLOT_BITS, np.int32)
        todo, at = np.arange(len(self.merge_keys)), self._slots(self.merge_keys)
        while len(todo):
            free = np.flatnonzero(~self.taken[at])
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.taken[at[won]], self.merge_at[at[won]] = True, todo[won]
            todo, at = np.delete(todo, won), np.delete(at, won)
            at = np.where(self.taken[at], (at + 1) & (len(self.taken) - 1), at)

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of joining two symbols; rank ``_NONE`` where no piece is made."""
        keys = left.astype(np.int64) << 32 | right
        rank, made = np.full(len(keys), _NONE), np.zeros(len(keys), np.int32)
        at = self._slots(keys)
        todo = np.flatnonzero(self.taken[at])  # most pairs make no piece
        at, keys = at[todo], keys[todo]
        while len(todo):
            merge = self.merge_at[at]
            found = self.merge_keys[merge] == keys
            rank[todo[found]], made[todo[found]] = self.merge_rank[merge[found]], self.merge_id[merge[found]]
            at = (at + 1) & (len(self.taken) - 1)
            rest = ~found & self.taken[at]
            todo, at, keys = todo[rest], at[rest], keys[rest]
        return rank, made

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _STEP >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _skipped(keys: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray, rate: float) -> np.ndarray:
    """Whether the keyed hash drops the candidate that joins [first, middle) and [middle, last)."""
    place = (first.astype(np.uint64) * _STEP + middle.astype(np.uint64)) * _STEP + last.astype(np.uint64)
    return (mixed(keys ^ mixed(place)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """:func:`words.mixed` of one integer."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _agenda(pieces: Pieces, symbols: np.ndarray, key: np.uint64, rate: float) -> np.ndarray:
    """The pieces of one unit, by a heap of candidate merges."""
    n, key, step, known = len(symbols), int(key), int(_STEP), pieces.rank_of
    ids, start = symbols.tolist(), list(range(n))
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple] = []

    def propose(i: int) -> None:
        j = after[i]
        found = known.get(ids[i] << 32 | ids[j])
        if found is None:
            return
        place = ((start[i] * step + start[j]) * step + end[j]) & _MASK
        if (_mixed(key ^ _mixed(place)) >> 11) * 2.0**-53 >= rate:
            heapq.heappush(heap, (found[0], i, ids[i], j, ids[j], end[j], found[1]))

    for i in range(n - 1):
        propose(i)
    while heap:
        _, i, left, j, right, stop, made = heapq.heappop(heap)
        if ids[i] != left or after[i] != j or ids[j] != right or end[j] != stop:
            continue
        ids[i], end[i], after[i], ids[j] = made, end[j], after[j], -1
        if after[j] < n:
            before[after[j]] = i
            propose(i)
        if before[i] >= 0:
            propose(before[i])
    return np.array([x for x in ids if x >= 0], np.uint32)


def _together(pieces: Pieces, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float):
    """The pieces of many units at once; every pass makes the best merge of each open unit."""
    n = len(lengths)
    unit = np.repeat(np.arange(n), lengths)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(symbols)) - begin[unit]
    stop = place + 1
    symbols = symbols.astype(np.int64)
    rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)

    def refresh(at: np.ndarray) -> None:
        at = at[(at >= 0) & (at < len(symbols))]
        joined = at + 1 < len(symbols)
        next_at = np.minimum(at + 1, len(symbols) - 1)
        joined &= unit[next_at] == unit[at]
        r, m = pieces.merge(symbols[at], symbols[next_at])
        r[~joined] = _NONE
        open_at = np.flatnonzero(r != _NONE)
        a, b = at[open_at], next_at[open_at]
        r[open_at[_skipped(keys[unit[a]], place[a], place[b], stop[b], rate)]] = _NONE
        rank[at], made[at] = r, m

    refresh(np.arange(len(symbols)))
    done_unit, done_symbol = [], []
    while len(symbols):
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        best = np.minimum.reduceat(np.where(rank == _NONE, _NONE, rank << 32 | np.arange(len(symbols))), first)
        closed = np.repeat(best == _NONE, np.diff(np.concatenate((first, [len(symbols)]))))
        if closed.any():
            done_unit.append(unit[closed])
            done_symbol.append(symbols[closed])
        at = (best[best != _NONE] & np.int64(0xFFFFFFFF)).astype(np.int64)
        symbols[at], stop[at] = made[at], stop[at + 1] if len(at) else stop[at]
        keep = ~closed
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        at = moved[at]
        unit, place, stop, symbols, rank, made = (x[keep] for x in (unit, place, stop, symbols, rank, made))
        refresh(np.concatenate((at, at - 1)))
    if not done_unit:
        return np.zeros(0, np.uint32), np.zeros(n, np.int64)
    unit, symbols = np.concatenate(done_unit), np.concatenate(done_symbol)
    return symbols[np.argsort(unit, kind="stable")].astype(np.uint32), np.bincount(unit, minlength=n)


def _candidates(pieces: Pieces, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every merge that some order of merges can propose in units of at most 255 symbols.

    A candidate is ``first << 16 | middle << 8 | last``; they come unit by unit, with their number in each.
    """
    begin = np.cumsum(lengths) - lengths
    unit = np.repeat(np.arange(len(lengths)), lengths)
    end = (begin + lengths)[unit]
    made = {1: symbols}  # by number of signs: the piece that begins at each place, or -1
    begins = {1: np.arange(len(symbols))}
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for size in range(2, min(pieces.longest, int(lengths.max(initial=0))) + 1):
        out = np.full(len(symbols), -1, np.int32)
        for cut in range(1, size):
            at = begins[cut]
            at = at[at + size <= end[at]]
            at = at[made[size - cut][at + cut] >= 0]
            rank, joined = pieces.merge(made[cut][at], made[size - cut][at + cut])
            at, joined = at[rank != _NONE], joined[rank != _NONE]
            out[at] = joined
            place = at - begin[unit[at]]
            owners.append(unit[at])
            found.append((place << 16 | (place + cut) << 8 | (place + size)).astype(np.uint32))
        made[size], begins[size] = out, np.flatnonzero(out >= 0)
    owner = np.concatenate(owners)
    return np.concatenate(found)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))


def _dropped(keys: np.ndarray, candidates: np.ndarray, lengths: np.ndarray, rate: float) -> np.ndarray:
    """A hash of the set of each unit's candidates that its key drops; 0 where it drops none."""
    first, middle, last = candidates >> np.uint32(16), candidates >> np.uint32(8) & np.uint32(255), candidates & np.uint32(255)
    at = np.flatnonzero(_skipped(np.repeat(keys, lengths), first, middle, last, rate))
    out = np.zeros(len(keys), np.uint64)
    np.add.at(out, np.repeat(np.arange(len(keys)), lengths)[at], mixed(candidates[at].astype(np.uint64)))
    return out


@lru_cache(maxsize=4)
def _loaded(path: str, rate: float, seed: int) -> tuple[Pieces, KeyedRows, KeyedRows, Seen, Seen]:
    """The model, the ids of units, the candidates of words, and which words and units came before."""
    return Pieces(path), KeyedRows(), KeyedRows(), Seen(), Seen()


def encode_rows(path: str, data: np.ndarray, offsets: np.ndarray, row_keys: np.ndarray, rate: float = RATE, seed: int = SEED):
    """Ids of each row and their offsets."""
    pieces, known, proposed, seen_words, seen_units = _loaded(path, rate, seed)
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    points = np.insert(np.where(points == SPACE, 0x110000, points), at[:-1][np.diff(at) > 0], 0x20)
    at = at + np.concatenate(([0], np.cumsum(np.diff(at) > 0)))
    points = np.where(points == 0x20, SPACE, points)
    known_char = points < 0x110000
    symbols = np.where(known_char, pieces.char_ids[np.where(known_char, points, 0)], -1)

    begins = np.zeros(len(points) + 1, bool)
    begins[at] = True
    space, bare = points == SPACE, symbols < 0
    begins[1:-1] |= (space[1:] & ~space[:-1]) | bare[1:] | bare[:-1]
    starts = np.flatnonzero(begins[:-1])
    ends = np.append(starts[1:], len(points))
    row = np.searchsorted(at, starts, side="right") - 1
    order = np.arange(len(starts)) - np.searchsorted(starts, at)[row]
    base = mixed(row_keys.astype(np.uint64) ^ mixed(np.uint64(seed) + np.zeros(1, np.uint64)))
    keys = mixed(base[row] + order.astype(np.uint64) * _STEP)
    names = range_hashes(points, starts, ends)

    def name(a: int, b: int) -> None:
        """Tell the units [a, b) apart by their words and what their keys drop; words that came once by their keys alone."""
        n = (ends - starts)[a:b]
        short = np.flatnonzero(n <= _LONG)
        _, word, count = np.unique(names[a:b][short], return_inverse=True, return_counts=True)
        again = seen_words.again(names[a:b][short]) | (count[word] > 1)
        short = short[again]
        at, n = starts[a:b][short], n[short]
        found, lengths = proposed.rows(names[a:b][short], lambda new: _candidates(pieces, gather(symbols, at[new], n[new]), n[new]))
        own = keys[a:b].copy()
        own[short] = _dropped(keys[a:b][short], found, lengths, rate)
        names[a:b] = mixed(names[a:b] + mixed(own))
        kept[a:b] = False
        kept[a:b][short] = seen_units.again(names[a:b][short]) | (own[short] == 0)

    kept = np.ones(len(starts), bool)
    for a in range(0, len(starts) if rate else 0, _UNITS):
        name(a, min(a + _UNITS, len(starts)))

    def make(first: np.ndarray):
        a, n = starts[first], (ends - starts)[first]
        alone = symbols[a] < 0
        lengths = np.zeros(len(first), np.int64)
        parts, order = [], []
        plain = np.flatnonzero(~alone & (n <= _HEAP))
        plain = plain[np.argsort(n[plain], kind="stable")]  # units of a length end at about the same pass
        for some in np.split(plain, np.searchsorted(np.cumsum(n[plain]), np.arange(_SYMBOLS, int(n[plain].sum()), _SYMBOLS))):
            flat, lengths[some] = _together(pieces, gather(symbols, a[some], n[some]), n[some], keys[first[some]], rate)
            parts.append(flat)
        order.append(plain)
        for i in np.flatnonzero(alone | (n > _HEAP)).tolist():
            if alone[i]:
                point = int(points[a[i]])
                out = pieces.byte_ids[list(chr(SPACE if point == 0x110000 else point).encode())]
            else:
                out = _agenda(pieces, symbols[a[i]:a[i] + n[i]], keys[first[i]], rate)
            lengths[i] = len(out)
            parts.append(out)
            order.append([i])
        order = np.concatenate(order).astype(np.int64)
        values = np.concatenate([np.zeros(0, np.uint32), *parts])
        begin = np.zeros(len(first), np.int64)
        begin[order] = np.cumsum(lengths[order]) - lengths[order]
        return gather(values, begin, lengths), lengths

    ids, lengths = known.rows(names, make, kept)
    return ids, np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, at)]


def decode_rows(path: str, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of each row of ids and their offsets; the leading space is taken off."""
    pieces = _loaded(path, 0.0, 0)[0]
    lengths = pieces.lengths[ids]
    data = gather(pieces.bytes, pieces.starts[ids], lengths)
    ends = np.concatenate(([0], np.cumsum(lengths)))[offsets]
    full = np.diff(ends) > 0
    data = np.delete(data, ends[:-1][full])
    return data, ends - np.concatenate(([0], np.cumsum(full)))


def _row_keys(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    return batch.column("doc_id").slice(a, b - a).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for a, b in slices(batch.num_rows, np.diff(utf8(batch.column("text"))[1]), _SLICE_BYTES):
            data, offsets = utf8(batch.column("text").slice(a, b - a))
            yield batch.column("doc_id").slice(a, b - a).cast(pa.int64()), data, offsets, _row_keys(batch, a, b)


def encode(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """``(doc_id, ids)`` of every text; ids are little-endian 32-bit integers."""

    def run(batches):
        for doc_ids, data, offsets, keys in _blocks(batches):
            ids, ends = encode_rows(path, data, offsets, keys, rate, seed)
            yield pa.record_batch({"doc_id": doc_ids, "ids": binaries(ids.astype("<u4"), ends)})

    return docs.select("doc_id", "text").mapInArrow(lean(run), ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of encoded rows; ids that spell no valid text fail."""

    def run(batches):
        for batch in batches:
            packed = [x or b"" for x in batch.column("ids").to_pylist()]
            ids = np.frombuffer(b"".join(packed), "<u4")
            data, ends = decode_rows(path, ids, np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int64))
            raw = data.tobytes()
            texts = [raw[x:y].decode() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.mapInArrow(run, "doc_id long, text string")


def encode_report(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """Per document the number and checksum of its ids, and whether they decode to its text."""

    def run(batches):
        for doc_ids, data, offsets, keys in _blocks(batches):
            ids, ends = encode_rows(path, data, offsets, keys, rate, seed)
            back, back_ends = decode_rows(path, ids, ends)
            same = np.diff(back_ends) == np.diff(offsets)
            raw, text, packed = back.tobytes(), data.tobytes(), ids.astype("<u4").tobytes()
            for i in np.flatnonzero(same).tolist():
                same[i] = raw[back_ends[i]:back_ends[i + 1]] == text[offsets[i]:offsets[i + 1]]
            sums = [zlib.crc32(packed[4 * x:4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch(
                {
                    "doc_id": doc_ids,
                    "n_ids": pa.array(np.diff(ends).astype(np.int64)),
                    "ids_crc32": pa.array(sums, pa.int64()),
                    "n_bytes": pa.array(np.diff(offsets).astype(np.int64)),
                    "lossless": pa.array(same),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), REPORT)
