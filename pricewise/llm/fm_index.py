"""FM-index over a wavelet tree, with matching statistics by backward search in step.

The Burrows-Wheeler transform of some strings is kept as a wavelet tree in level order:
one bit vector for each bit of a symbol, packed in 64-bit words with a running count of
the ones before each word. A rank costs one look-up and one population count a level, and
many ranks are taken at once. Longest common prefixes of neighbouring rows are kept up to
``cap`` symbols, in a byte each: they widen an interval when a match has to be shortened.
"""
from __future__ import annotations

import numpy as np

_SIX, _LOW = np.int64(6), np.int64(63)


class WaveletTree:
    """Ranks of symbols in a sequence of non-negative integers."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length()) if symbols > 1 else 1
        self.size = len(sequence)
        self.words, self.ones, self.zeros = [], [], []
        s = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(s) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.uint32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])
        # where each symbol's stretch begins on the last level
        self.start = self._down(np.arange(symbols, dtype=np.int64), np.zeros(symbols, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> _SIX
            below = (np.uint64(1) << (at & _LOW).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word].astype(np.int64) + np.bitwise_count(self.words[k][word] & below)
            at = np.where((symbol >> level) & 1 == 1, ones + self.zeros[k], at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """Index of strings of symbols 1, 2, ...; matches do not cross strings.

    ``symbols`` has the strings one after another, ``size`` their lengths. Suffixes end
    with their string; equal ones stand in the order of the strings. ``rows[i]`` is the
    place in ``symbols`` (counting an end mark after every string) of the i-th suffix.
    """

    def __init__(self, symbols: np.ndarray, size: np.ndarray, cap: int):
        self.cap = cap
        n = len(symbols) + len(size)
        end = np.cumsum(size + 1) - 1
        body = np.ones(n, dtype=bool)
        body[end] = False
        text = np.zeros(n, dtype=np.int64)
        text[body] = symbols
        owner = np.repeat(np.arange(len(size)), size + 1)
        left = end[owner] - np.arange(n)  # symbols before the end of the string
        self.rows, ranks = self._sorted(text, left, owner)
        self.alphabet = int(text.max(initial=0)) + 1
        before = text[self.rows - 1]
        self.tree = WaveletTree(before, self.alphabet)
        count = np.bincount(before, minlength=self.alphabet)
        self.first = np.cumsum(count) - count
        self.count = count
        self.lcp = self._common(ranks, left)
        # bounds of the rows that share `cap` symbols
        new = np.flatnonzero(self.lcp < cap)
        self.group = np.searchsorted(new, np.arange(n), side="right") - 1
        self.group_edge = np.append(new, n)
        self._edges: dict[int, np.ndarray] = {}

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.cumsum(np.append(0, k[1:] != k[:-1])) if len(k) else 0
        return rank

    def _sorted(self, text, left, owner) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by prefix doubling, and the ranks by 1, 2, 4, ... symbols."""
        n, reach, longest = len(text), 1, int(left.max(initial=0)) + 1
        rank = text
        ranks = [(1, rank)]
        while reach < longest:
            second = np.zeros(n, dtype=np.int64)
            second[:n - reach] = np.where(left[:n - reach] >= reach, rank[reach:] + 1, 0)
            rank = self._rank(rank * (n + 2) + second)
            reach *= 2
            if reach <= self.cap:
                ranks.append((reach, rank))
        return np.argsort(rank * (int(owner[-1]) + 1) + owner if n else rank), ranks

    def _common(self, ranks, left) -> np.ndarray:
        """Common prefix of each row with the row before, up to ``cap`` (-1 for the first)."""
        a, b = self.rows[:-1], self.rows[1:]
        got = np.zeros(len(a), dtype=np.int64)
        last = len(left) - 1
        # the ranks say "equal in r symbols": after the longest steps the shorter ones
        steps = [(r, rank) for r, rank in reversed(ranks)]
        while steps:
            r, rank = steps[0]
            same = (rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)]) & (left[a] >= got + r) & (left[b] >= got + r)
            got += np.where(same, r, 0)
            if not (same & (got < self.cap)).any():
                steps.pop(0)
        return np.append(-1, np.minimum(got, self.cap)).astype(np.int8 if self.cap < 128 else np.int32)

    def _interval(self, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the rows that share ``depth`` symbols with each row."""
        if depth not in self._edges:
            self._edges[depth] = np.append(np.flatnonzero(self.lcp < depth), len(self.lcp))
        edge = self._edges[depth]
        k = np.searchsorted(edge, row, side="right") - 1
        return edge[k], edge[k + 1]

    def extended(self, symbol, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """Interval of ``symbol`` followed by what the interval [lo, hi) stands for."""
        return self.first[symbol] + self.tree.rank(symbol, lo), self.first[symbol] + self.tree.rank(symbol, hi)

    def matching_statistics(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every place of the strings in ``symbols``: length of the longest match that
        starts there, up to ``cap``, and the interval of rows [lo, hi) that have it.
        Symbols that the index has not (0, or beyond its alphabet) match nothing."""
        total, n = len(symbols), len(self.lcp)
        length = np.zeros(total, dtype=np.int64)
        low, high = np.zeros(total, dtype=np.int64), np.full(total, n, dtype=np.int64)
        if not total or not n:
            return length, low, high
        order = np.argsort(-size, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        m = len(size)
        lo, hi, got = np.zeros(m, np.int64), np.full(m, n, np.int64), np.zeros(m, np.int64)
        for t in range(int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = begin[:live] + size[:live] - 1 - t
            symbol = symbols[at]
            known = (symbol > 0) & (symbol < self.alphabet)
            lo[:live][~known], hi[:live][~known], got[:live][~known] = 0, n, 0
            todo = np.flatnonzero(known)
            while len(todo):
                a, b = self.extended(symbol[todo], lo[todo], hi[todo])
                fine = a < b
                done = todo[fine]
                lo[done], hi[done] = a[fine], b[fine]
                got[done] += 1
                todo = todo[~fine]
                todo = todo[got[todo] > 0]
                # no match: drop symbols at the right until the interval grows
                after = np.minimum(hi[todo], n - 1)
                shorter = np.maximum(np.maximum(self.lcp[lo[todo]], np.where(hi[todo] < n, self.lcp[after], -1)), 0)
                for depth in np.unique(shorter).tolist():
                    own = todo[shorter == depth]
                    if depth:
                        lo[own], hi[own] = self._interval(lo[own], depth)
                    else:
                        lo[own], hi[own] = 0, n
                    got[own] = depth
            over = np.flatnonzero(got[:live] > self.cap)
            if len(over):
                g = self.group[lo[over]]
                lo[over], hi[over], got[over] = self.group_edge[g], self.group_edge[g + 1], self.cap
            length[at], low[at], high[at] = got[:live], lo[:live], hi[:live]
        return length, low, high
