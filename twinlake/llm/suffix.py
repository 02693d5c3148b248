"""Suffix arrays, common prefixes and a wavelet matrix over integer arrays in numpy."""

from __future__ import annotations

import numpy as np


def larsson_sadakane(s: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of an integer array; a suffix that ends is smaller than any that goes on.

    Every round doubles the length by which suffixes are told apart and sorts again only those in groups of two or more.
    With depth, refinement stops once that many first symbols are told apart: equal ranks then mean equal prefixes."""
    n = len(s)
    sa = np.argsort(s, kind="stable").astype(np.int64)
    rank = np.empty(n, np.int64)
    head = np.ones(n, bool)
    np.not_equal(s[sa[1:]], s[sa[:-1]], out=head[1:])
    at = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(head, at, 0))
    lone = head & np.append(head[1:], True)
    active, k = at[~lone], 1
    while len(active) and (depth is None or k < depth):
        suffix = sa[active]
        beyond = suffix + k
        key = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key += rank[suffix] * (n + 1)
        order = np.argsort(key)
        suffix, key = suffix[order], key[order]
        sa[active] = suffix
        head = np.ones(len(active), bool)
        np.not_equal(key[1:], key[:-1], out=head[1:])
        rank[suffix] = np.maximum.accumulate(np.where(head, active, 0))
        active = active[~(head & np.append(head[1:], True))]
        k *= 2
    return sa, rank


class WaveletMatrix:
    """Rank and access over an array of integers below 2 ** bits, for whole arrays of queries."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.n, self.bits, self.levels = len(values), bits, []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            self.levels.append((level, words, before, self.n - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        first = np.zeros(len(symbol), np.int64)
        i = i.copy()
        for level, words, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self._ones(words, before, first), self._ones(words, before, i)
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
        return i - first

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol = np.zeros(len(i), np.int64)
        first, i = np.zeros(len(i), np.int64), i.copy()
        for level, words, before, zeros in self.levels:
            one = ((words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            symbol |= one.astype(np.int64) << level
            a, b = self._ones(words, before, first), self._ones(words, before, i)
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
        return symbol, i - first


class FMIndex:
    """Full-text index of runs of positive symbols, laid end to end with a separator after each.

    Holds the Burrows-Wheeler transform as a wavelet matrix and the suffix positions of every ``step``-th place and of every
    run's start, so a walk to the left from an occurrence ends inside its run."""

    def __init__(self, symbols: np.ndarray, run_starts: np.ndarray, highest: int, step: int = 32) -> None:
        """symbols: 0 is the separator, and the last symbol is one."""
        n = len(symbols)
        gap = symbols == 0
        told = np.where(gap, np.cumsum(gap), symbols.astype(np.int64) + int(gap.sum()))  # separators differ, so no tie crosses one
        sa, _ = larsson_sadakane(told)
        self.n = n
        self.bwt = WaveletMatrix(symbols[sa - 1].astype(np.int64), max(1, int(highest).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=highest + 1))])
        kept = np.zeros(n, bool)
        kept[::step] = True
        kept[run_starts] = True
        self.kept = kept[sa]
        self.place = sa[self.kept]
        self.nth = np.cumsum(self.kept) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows of equal length) at once: the first row and the end of each one's interval."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            a, b = self.before[c] + self.bwt.rank(c, lo[live]), self.before[c] + self.bwt.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, lo, 0), np.where(found, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row of the suffix array."""
        out, steps, rows, live = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(live):
            done = self.kept[rows]
            out[live[done]] = self.place[self.nth[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            if len(live):
                c, before = self.bwt.access(rows)
                rows = self.before[c] + before
            steps += 1
        return out


def neighbours(s: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in sorted order (0 for the first).

    Kasai's rule in text order: where the predecessor moves on by one, as the text does, over a symbol that both share, the length
    falls by one; the other places are compared symbol by symbol, all at once.  The array's symbols must tell all suffixes apart before its end."""
    n = len(s)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = np.append(False, (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (s[:-1] == s[before[:-1]]))
    heads = np.flatnonzero(~follows)
    size = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(before[heads] >= 0)
    while len(live):
        a, b = heads[live] + size[live], before[heads[live]] + size[live]
        same = (a < n) & (b < n)
        same[same] = s[a[same]] == s[b[same]]
        live = live[same]
        size[live] += 1
    at = np.cumsum(~follows) - 1
    length = np.maximum(size[at] - (np.arange(n) - heads[at]), 0)
    return length[sa]
