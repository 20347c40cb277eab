"""A hash table from 63-bit integers to row numbers, looked up by whole arrays."""

from __future__ import annotations

import numpy as np

EMPTY = -1


class IntTable:
    def __init__(self, bits: int = 16) -> None:
        self.size = 0
        self._allot(bits)

    def _allot(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.full(1 << bits, EMPTY, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key (not negative), or -1."""
        slots = self._slots(keys)
        held = self.keys[slots]
        rows = np.where(held == keys, self.rows[slots], EMPTY)
        on = np.flatnonzero((held != keys) & (held != EMPTY))
        while len(on):
            slots[on] = (slots[on] + 1) & self.mask
            held = self.keys[slots[on]]
            hit = held == keys[on]
            rows[on[hit]] = self.rows[slots[on[hit]]]
            on = on[~hit & (held != EMPTY)]
        return rows

    def add(self, keys: np.ndarray) -> None:
        """Give distinct new keys the next rows, in order."""
        rows = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        if self.size * 3 > len(self.keys):
            old, old_rows = self.keys[self.keys != EMPTY], self.rows[self.keys != EMPTY]
            self._allot(max(16, (self.size * 6).bit_length()))
            self._put(old, old_rows)
        self._put(keys, rows)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == EMPTY
            self.keys[slots[free]] = keys[free]
            won = self.keys[slots] == keys
            self.rows[slots[won]] = rows[won]
            keys, rows, slots = keys[~won], rows[~won], (slots[~won] + 1) & self.mask
