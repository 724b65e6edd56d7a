"""FM-index with a wavelet matrix over a sequence of symbols.

Suffixes are sorted by prefix doubling, in which only groups that are still
tied are sorted again.  Symbol 0 separates texts; separators differ from each
other, in order of position, so no suffix order looks past one.  The index
answers backward search and locates occurrences through sampled suffix
positions; all patterns are searched at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; symbols are below the largest int64, 0 separates."""
    n = len(symbols)
    stops = symbols == 0
    rank = symbols.astype(np.int64) + int(stops.sum())
    rank[stops] = np.arange(int(stops.sum()))
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = head[np.cumsum(new) - 1]  # the first place of the group
    step = 1
    while True:
        # places of groups with more than one suffix
        last = np.append(new[1:], True)
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            return order
        at = order[tied]
        after = rank[np.minimum(at + step, n - 1)]
        after = np.where(at + step < n, after, -1)
        group = rank[at]
        inner = np.lexsort((after, group))
        at, after, group = at[inner], after[inner], group[inner]
        order[tied] = at
        first = np.ones(len(tied), bool)
        first[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[tied] = first
        rank[at] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        step *= 2


class WaveletMatrix:
    """rank(c, i): how often c occurs among the first i symbols."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            sums = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=sums[1:])
            self.ones.append(sums)
            self.zeros.append(len(symbols) - int(sums[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for k, (sums, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = sums[start], sums[i]
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(i), np.int64), i.astype(np.int64)
        for sums, zeros in zip(self.ones, self.zeros, strict=True):
            before = sums[i]
            one = (sums[i + 1] - before).astype(bool)
            out = 2 * out + one
            i = np.where(one, zeros + before, i - before)
        return out


class Index:
    """Over symbols >= 1 with separators 0; the last symbol has to be a separator."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(symbols)
        last = symbols[order - 1]  # the symbol before each suffix
        self.wavelet = WaveletMatrix(last)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.size = len(symbols)
        self.sampled = np.zeros(self.size + 1, np.int32)
        hit = order % sample == 0
        # a walk ends at a sampled place, or at one before which there is a separator
        hit |= last == 0
        np.cumsum(hit, out=self.sampled[1:])
        self.places = order[hit]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of each pattern (a row of symbols, left-aligned)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        live = np.arange(len(patterns))
        for k in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > k) & (low[live] < high[live])]
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - k]
            known = c + 1 < len(self.below)
            low[live[~known]] = high[live[~known]] = 0
            live, c = live[known], c[known]
            low[live] = self.below[c] + self.wavelet.rank(c, low[live])
            high[live] = self.below[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of the suffix in each row."""
        out, rows, left, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(left):
            there = self.sampled[rows + 1] > self.sampled[rows]
            out[left[there]] = self.places[self.sampled[rows[there]]] + steps
            left, rows = left[~there], rows[~there]
            if len(left):
                c = self.wavelet.access(rows)
                rows = self.below[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out
