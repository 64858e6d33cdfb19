"""Bulk hash tables over integer keys."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class HashTable:
    """Open addressing over distinct non-negative int64 keys, built and probed in bulk."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(3, int(2 * max(len(keys), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.value = np.zeros(1 << bits, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several at one slot the last stays
            placed = self.keys[slot] == keys[left]
            self.value[slot[placed]] = left[placed]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among those it was built of, or -1."""
        out = np.full(len(keys), -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.value[slot[hit]]
            on = ~hit & (there != -1)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out
