"""An FM-index over sequences of word numbers, with many patterns searched at once.

The suffix array is built by prefix doubling (only suffixes that still tie are sorted again); ranks in the
Burrows-Wheeler transform come from a wavelet matrix of packed bits; of the suffix array only every
``SAMPLE``-th text position is kept, others are reached by last-to-first steps.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order; the last symbol must be the least and occur once."""
    n = len(text)
    if n <= 1:
        return np.arange(n)
    bits = max(1, int(text.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.uint64)
    wide = np.concatenate([text, np.zeros(step, text.dtype)]).astype(np.uint64)
    for k in range(step):
        key = (key << np.uint64(bits)) | wide[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        here = order[at]
        follow = here + step
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        again = np.lexsort((second, start[at]))
        here, second = here[again], second[again]
        order[at] = here
        group = start[at]
        differs = np.ones(len(at), bool)
        differs[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[at] = differs
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[here] = start[at]
        step *= 2


class _Bits:
    """A bit vector with constant-time counts of ones before a position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """``symbols`` from 1 up; 0 is kept for the end."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        last = text[order - 1]
        self.n = len(text)
        self.sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels: list[tuple[int, _Bits, int]] = []
        for b in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (last >> b) & 1 == 1
            self.levels.append((b, _Bits(bit), int(len(bit) - bit.sum())))
            last = np.concatenate([last[~bit], last[bit]])
        kept = order % SAMPLE == 0
        self.kept, self.samples = _Bits(kept), order[kept]

    def _rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each position."""
        begin = np.zeros_like(i)
        for b, bits, zeros in self.levels:
            one = (symbol >> b) & 1 == 1
            r, s = bits.ones(i), bits.ones(begin)
            i, begin = np.where(one, zeros + r, i - r), np.where(one, zeros + s, begin - s)
        return i - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of ``patterns`` (all of one length)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero((patterns < self.sigma).all(axis=1))
        high[np.setdiff1d(np.arange(len(patterns)), alive)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive] = self.first[c] + self._rank(c, low[alive])
            high[alive] = self.first[c] + self._rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            found = self.kept.get(rows[todo]) == 1
            done = todo[found]
            out[done] = (self.samples[self.kept.ones(rows[done])] + steps[done]) % self.n
            todo = todo[~found]
            i, begin, symbol = rows[todo], np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
            for b, bits, zeros in self.levels:
                one = bits.get(i) == 1
                symbol |= one.astype(np.int64) << b
                r, s = bits.ones(i), bits.ones(begin)
                i, begin = np.where(one, zeros + r, i - r), np.where(one, zeros + s, begin - s)
            rows[todo] = self.first[symbol] + i - begin
            steps[todo] += 1
        return out
