"""An FM-index over a sequence of symbols: suffix order, its last column in a wavelet matrix, and sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of s (symbols 0..k) in order; a suffix that ends comes before one that goes on.

    Several symbols at a time are packed into the first key; after that only suffixes that are still tied are sorted again, by
    the ranks that lie twice as far ahead each time.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(s.max() + 1).bit_length()
    ahead = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(ahead):
        key <<= bits
        if k < n:
            key[: n - k] |= s[k:].astype(np.int64) + 1
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    # a rank is the place of the first of its group
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # places in groups of two or more
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = sa[tied]
        group, then = rank[at], rank[np.minimum(at + ahead, n)]
        order = np.lexsort((then, group))
        at, group, then = at[order], group[order], then[order]
        sa[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        ahead *= 2
    return sa


class Bits:
    """A bit array with ranks: 64-bit words, and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.word = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.word.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.word), np.int64)
        np.cumsum(np.bitwise_count(self.word[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.word[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.word[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Ranks of any symbol in a sequence, by one bit array for each bit of the symbols."""

    def __init__(self, s: np.ndarray, n_symbols: int):
        self.levels = []
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            b = (s >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(b), int(len(s) - b.sum())))
            s = np.concatenate([s[~b], s[b]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Number of c before position i, less an offset that depends on c only (see start)."""
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(c >> bit & 1, zeros + ones, i - ones)
        return i

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and rank(symbol, position)."""
        c = np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            c |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return c, i


class FMIndex:
    """Backward search and location of patterns in one sequence of symbols 0..n_symbols - 1; any of them may occur in patterns.

    Inside, symbols are one higher: 0 is the terminal, which occurs once. (With several equal terminals the step from the last
    column to the first isn't that of the text.)
    """

    def __init__(self, s: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        s = np.append(np.asarray(s, np.int64) + 1, 0)
        n_symbols += 1
        sa = suffix_array(s)
        self.n, self.sample = len(s), sample
        self.wavelet = Wavelet(s[sa - 1], n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols))])
        self.start = self.wavelet.rank(np.arange(n_symbols), np.zeros(n_symbols, np.int64))
        marked = sa % sample == 0
        self.marked = Bits(marked)
        self.sampled = sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of suffixes that begin with each row of patterns."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            alive = np.flatnonzero(low < high)
            c = patterns[alive, k] + 1
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low[alive], high[alive]]))
            base = self.first[c] - self.start[c]
            low[alive], high[alive] = base + both[: len(c)], base + both[len(c) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes given by their place in the order; one in `sample` is known, so no walk is longer."""
        out = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        for steps in range(self.sample):
            hit = self.marked.get(rows)
            out[left[hit]] = self.sampled[self.marked.rank(rows[hit])] + steps
            left, rows = left[~hit], rows[~hit]
            if not len(left):
                return out
            c, i = self.wavelet.get(rows)
            rows = self.first[c] + i - self.start[c]
        raise AssertionError(f"{len(left)} walks have passed no sampled position")
