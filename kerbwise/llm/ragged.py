"""Rows of unequal length as flat numpy arrays, and a bounded table of them by 64-bit key."""

from __future__ import annotations

import numpy as np


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[start:start + length]`` for each pair."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Seen:
    """Which keys came before: a table of bits by hash, emptied when half full.

    It only steers work: a key taken for another one's, or forgotten, costs time or a place in a cache.
    """

    def __init__(self, bits: int = 22):
        self.bits = np.zeros(1 << bits, bool)
        self.held = 0

    def again(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key came in an earlier call; all of them count as seen from now on."""
        at = (keys & np.uint64(len(self.bits) - 1)).astype(np.int64)
        before = self.bits[at]
        self.held += int((~before).sum())
        if 2 * self.held > len(self.bits):
            self.bits[:] = False
            self.held = 0
        self.bits[at] = True
        return before


class KeyedRows:
    """Rows of integers by key, in at most about ``max_bytes``; it starts afresh when full.

    Rows of more than ``longest`` integers are not kept. It only saves work: a row that is gone is computed again.
    """

    def __init__(self, max_bytes: int = 48 << 20, longest: int = 64):
        self.longest = longest
        slots = 1 << 10
        while 2 * 20 * slots <= max_bytes * 2 // 3:  # a key's place takes 20 bytes
            slots *= 2
        self.max_slots, self.max_values = slots, max((max_bytes - 20 * slots) // 4, 1024)
        self._clear()

    def _clear(self) -> None:
        self.held = 0
        self.values = np.zeros(1024, np.uint32)
        self.used = 0
        self._slots(min(1 << 16, self.max_slots))

    def _slots(self, n: int) -> None:
        """An open hash table of ``n`` places; a place of length -1 is free."""
        self.keys = np.zeros(n, np.uint64)
        self.starts, self.lengths = np.zeros(n, np.int64), np.full(n, -1, np.int32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, or the free place where its probing ends, and whether it is held."""
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        held = self.keys[at] == keys
        held &= self.lengths[at] >= 0
        todo = np.flatnonzero(~held & (self.lengths[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            same = (self.keys[at[todo]] == keys[todo]) & (self.lengths[at[todo]] >= 0)
            held[todo[same]] = True
            todo = todo[~same & (self.lengths[at[todo]] >= 0)]
        return at, held

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return self._find(keys)[1]

    def _place(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Put distinct new keys in free places; of keys that want one place the first gets it."""
        todo = np.arange(len(keys))
        while len(todo):
            at, _ = self._find(keys[todo])
            _, winners = np.unique(at, return_index=True)
            won = todo[winners]
            self.keys[at[winners]], self.starts[at[winners]], self.lengths[at[winners]] = keys[won], starts[won], lengths[won]
            todo = np.delete(todo, winners)

    def _add(self, keys: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> None:
        if 2 * (self.held + len(keys)) > self.max_slots or self.used + len(rows) > self.max_values:
            self._clear()
            if 2 * len(keys) > self.max_slots or len(rows) > self.max_values:
                return
        if self.used + len(rows) > len(self.values):
            grown = np.zeros(min(max(2 * len(self.values), self.used + len(rows)), self.max_values), np.uint32)
            grown[: self.used] = self.values[: self.used]
            self.values = grown
        self.values[self.used:self.used + len(rows)] = rows
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(rows)
        self.held += len(keys)
        if 2 * self.held > len(self.keys):
            old = self.lengths >= 0
            keys = np.concatenate((self.keys[old], keys))
            starts, lengths = np.concatenate((self.starts[old], starts)), np.concatenate((self.lengths[old], lengths))
            self._slots(min(1 << int(4 * self.held - 1).bit_length(), self.max_slots))
        self._place(keys, starts, lengths)

    def rows(self, keys: np.ndarray, make, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``keys``, concatenated, and their lengths.

        ``make(first)`` gets, for each key that is not held, the place of its first
        occurrence in ``keys``, and returns the concatenated new rows and their lengths. Where ``keep``
        is given, only the keys marked in it are held.
        """
        at, held = self._find(keys)
        lengths = np.where(held, self.lengths[at], 0).astype(np.int64)
        if held.all():
            return gather(self.values, self.starts[at], lengths), lengths
        absent = np.flatnonzero(~held)
        new, first, which = np.unique(keys[absent], return_index=True, return_inverse=True)
        made, size = make(absent[first])
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        lengths[absent] = size[which]
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]), np.uint32)
        if held.any():
            there = np.flatnonzero(held)
            out[gather(np.arange(len(out)), (ends - lengths)[there], lengths[there])] = gather(self.values, self.starts[at[there]], lengths[there])
        out[gather(np.arange(len(out)), (ends - lengths)[absent], lengths[absent])] = gather(made, begin[which], lengths[absent])
        kept = size <= self.longest
        if keep is not None:
            kept &= keep[absent[first]]
        self._add(new[kept], gather(made, begin[kept], size[kept]), size[kept])
        return out, lengths
