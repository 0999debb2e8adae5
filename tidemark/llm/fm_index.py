"""An FM-index over word symbols: suffix order, wavelet-matrix ranks and sampled positions, in numpy."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Symbol 0 separates runs; separators count as distinct, in text order, and least."""
    n = len(symbols)
    is_end = symbols == 0
    rank = np.where(is_end, np.cumsum(is_end) - 1, symbols.astype(np.int64) + is_end.sum())
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.zeros(n, np.int64)
        changed = np.zeros(n, bool)
        changed[1:] = sorted_rank[1:] != sorted_rank[:-1]
        new[order] = np.cumsum(changed)
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        # a suffix whose rank is already its own keeps it, whatever follows
        follow = np.zeros(n, np.int64)
        follow[:-step] = rank[step:] + 1
        rank = rank * (n + 1) + follow
        order = np.argsort(rank, kind="stable")
        step *= 2


class WaveletMatrix:
    """Rank of a symbol in a prefix, one bit level at a time, for many (symbol, position) at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels, self.n = max(1, int(top).bit_length()), len(values)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position upto."""
        first = np.zeros_like(upto)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            first = np.where(bit, zeros + ones[first], first - ones[first])
            upto = np.where(bit, zeros + ones[upto], upto - ones[upto])
        return upto - first


class ShardIndex:
    """FM-index of runs of symbols 1..top, each run ended by a 0."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        order = suffix_order(symbols)
        self.n = n
        self.bwt = symbols[order - 1]  # the first suffix is preceded by the last symbol, a separator
        self.ranks = WaveletMatrix(self.bwt, top)
        self.before = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=top + 1), out=self.before[1:])
        starts = np.zeros(n, bool)
        starts[0:1] = True
        starts[1:] = symbols[:-1] == 0
        sampled = (order % SAMPLE == 0) | starts[order]
        self.sampled = sampled
        self.sample_row = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern; patterns are right-aligned in the matrix."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = patterns[live, -back]
            low[live] = self.before[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled row."""
        rows, at, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            here = self.sampled[rows[live]]
            hit = live[here]
            at[hit] = self.samples[self.sample_row[rows[hit]]] + steps
            live = live[~here]
            symbol = self.bwt[rows[live]]
            rows[live] = self.before[symbol] + self.ranks.rank(symbol, rows[live])
            steps += 1
        return at
