"""A compressed full-text index over words: backward search over a wavelet matrix of the Burrows-Wheeler transform.

The index knows its text up to a depth: suffixes are sorted by their first words, somewhat more than
``depth`` of them, so that intervals of all patterns of at most ``depth`` + 1 words are exact, and matching
statistics are capped at ``depth``. Many patterns are searched for side by side, each step in arrays.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A packed bit vector with ranks: 1.5 bits for each of its bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, U)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.uint32)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        below = self.words[word] & ((U(1) << (i & 63).astype(U)) - U(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(below)


class WaveletMatrix:
    """Symbols as a bit vector for each of their bits, highest first; each level sorts by the bits above, zeros first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.shifts = range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1)
        self.levels = []
        x = symbols
        for s in self.shifts:
            bit = (x >> s & 1).astype(bool)
            self.levels.append(Bits(bit))
            x = np.concatenate([x[~bit], x[bit]])
        every = np.arange(n_symbols)
        self.start = self._descend(every, np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for s, level in zip(self.shifts, self.levels, strict=True):
            ones = level.rank(i)
            i = np.where(symbol >> s & 1 == 1, level.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Places before i that hold the symbol."""
        return self._descend(symbol, i) - self.start[symbol]


class FMIndex:
    """Index of a text of symbols from 1, in which 0 parts its pieces and ends it. ``order`` sorts its suffixes."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.depth = len(text), depth
        n_symbols = int(text.max(initial=0)) + 1
        # prefix doubling: ranks[j] orders suffixes by their first 2^j symbols
        ranks, size = [text.astype(np.int64)], 1
        while size <= depth:
            r = ranks[-1]
            further = np.zeros(self.n, np.int64)
            further[: max(0, self.n - size)] = r[size:] + 1
            ranks.append(np.unique(r * (int(r.max(initial=0)) + 2) + further, return_inverse=True)[1])
            size *= 2
        self.order = np.argsort(ranks[-1], kind="stable")
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        self.bwt = WaveletMatrix(text[self.order - 1], n_symbols)
        # words that suffixes next to each other have in common, up to the depth; lcp[i] is that of i - 1 and i
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(max(0, self.n - 1), np.int64)
        for j in range(len(ranks) - 2, -1, -1):
            inside = (a < self.n) & (b < self.n)
            same = np.zeros(len(a), bool)
            same[inside] = ranks[j][a[inside]] == ranks[j][b[inside]]
            step = same * (1 << j)
            common, a, b = common + step, a + step, b + step
        self.lcp = np.r_[-1, np.minimum(common, depth), -1].astype(np.int16)
        self._cuts: dict[int, np.ndarray] = {}

    def cuts(self, d: int) -> np.ndarray:
        """Where the intervals of patterns of d words begin; the last one ends at n."""
        if d not in self._cuts:
            self._cuts[d] = np.flatnonzero(self.lcp < d)
        return self._cuts[d]

    def around(self, i: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns of d words in which the places i of the order lie."""
        cuts = self.cuts(d)
        at = np.searchsorted(cuts, i, "right")
        return cuts[at - 1], cuts[at]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of patterns with a symbol put before them."""
        return self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)

    def matching_statistics(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place in the order) of the longest match that begins at each place of each sequence.

        Lengths stop at the depth. Sequences are symbols[start:end], read from right to left; a symbol below 1
        is one that the text lacks. A match that cannot be extended falls back to the longest shorter one
        that more of the text has.
        """
        length_at, place_at = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        by_size = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[by_size], ends[by_size]
        lo, hi, length = np.zeros(len(starts), np.int64), np.full(len(starts), self.n), np.zeros(len(starts), np.int64)
        live = np.searchsorted(starts - ends, -np.arange(1, int((ends - starts).max(initial=0)) + 1), "right")
        for t, n in enumerate(live):
            at = ends[:n] - 1 - t
            symbol = symbols[at]
            open_ = np.flatnonzero(symbol >= 1)
            none = np.flatnonzero(symbol < 1)
            lo[none], hi[none], length[none] = 0, self.n, 0
            while len(open_):
                a, b = self.extend(symbol[open_], lo[open_], hi[open_])
                good = a < b
                done = open_[good]
                lo[done], hi[done], length[done] = a[good], b[good], length[done] + 1
                open_ = open_[~good]
                stuck = open_[length[open_] == 0]  # not even the symbol alone
                lo[stuck], hi[stuck] = 0, self.n
                open_ = open_[length[open_] > 0]
                shorter = np.maximum(np.maximum(self.lcp[lo[open_]], self.lcp[hi[open_]]).astype(np.int64), 0)
                for d in np.unique(shorter):
                    some = open_[shorter == d]
                    lo[some], hi[some] = self.around(lo[some], d) if d else (0, self.n)
                length[open_] = shorter
            deep = np.flatnonzero(length[:n] > self.depth)
            lo[deep], hi[deep] = self.around(lo[deep], self.depth)
            length[deep] = self.depth
            length_at[at], place_at[at] = length[:n], lo[:n]
        return length_at, place_at
