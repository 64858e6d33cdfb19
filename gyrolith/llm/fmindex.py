"""FM-index over a sequence of symbols: suffix order, wavelet matrix, backward search, sampled locate."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling.  Zeros are separators: each sorts by its position,
    below every symbol, so no comparison runs past one."""
    n = len(seq)
    zero = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(zero)
    rank[zero] = np.arange(len(zero))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        fresh = np.cumsum(np.r_[0, sorted_rank[1:] != sorted_rank[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        second = np.full(n, 0, np.int64)
        second[: n - step] = rank[step:] + 1
        order = np.argsort(rank * (n + 1) + second, kind="stable")
        key = (rank * (n + 1) + second)[order]
        fresh = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        rank[order] = fresh
        step *= 2


class WaveletMatrix:
    """Rank of a symbol before a position, and symbol and rank at a position, in bulk."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        cur = seq.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            one = (cur >> b & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~one)].astype(np.int32)
            self.levels.append((one, zeros, int(zeros[-1])))
            cur = np.concatenate([cur[~one], cur[one]])
        # where each symbol's block begins in the last arrangement
        values, first = np.unique(cur, return_index=True)
        self.block = np.zeros(top + 1, np.int64)
        self.block[values] = first

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often symbol occurs before the position.  Symbols must occur in the sequence."""
        i = before.astype(np.int64)
        for k, (_, zeros, total) in enumerate(self.levels):
            z = zeros[i].astype(np.int64)
            i = np.where(symbol >> (self.bits - 1 - k) & 1, total + i - z, z)
        return i - self.block[symbol]

    def at(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each row and how often it occurs before that row."""
        i, symbol = row.astype(np.int64), np.zeros(len(row), np.int64)
        for one, zeros, total in self.levels:
            bit = one[i]
            z = zeros[i].astype(np.int64)
            i = np.where(bit, total + i - z, z)
            symbol = symbol << 1 | bit
        return symbol, i - self.block[symbol]


class FMIndex:
    def __init__(self, seq: np.ndarray, top: int) -> None:
        """seq: symbols 1..top, parts separated by zeros, the last element a zero."""
        n = len(seq)
        order = suffix_order(seq)
        bwt = seq[(order - 1) % n]
        count = np.bincount(seq, minlength=top + 1)
        self.start = np.r_[0, np.cumsum(count)]
        self.count = count
        self.wavelet = WaveletMatrix(bwt, top)
        begins = np.r_[True, seq[:-1] == 0]
        self.kept = np.flatnonzero((order % SAMPLE == 0) | begins[order])
        self.is_kept = np.zeros(n, bool)
        self.is_kept[self.kept] = True
        self.kept_rank = np.cumsum(self.is_kept) - 1
        self.kept_at = order[self.kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that begin with each pattern (rows of a matrix)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), int(self.start[-1]))
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            there = self.count[c] > 0
            hi[live[~there]] = lo[live[~there]]
            live, c = live[there], c[there]
            lo[live] = self.start[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.start[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of each row's suffix, walking back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        row, left, steps = rows.astype(np.int64), np.arange(len(rows)), 0
        while len(left):
            hit = self.is_kept[row]
            out[left[hit]] = self.kept_at[self.kept_rank[row[hit]]] + steps
            row, left = row[~hit], left[~hit]
            if len(left):
                symbol, rank = self.wavelet.at(row)
                row = self.start[symbol] + rank
            steps += 1
        return out
