"""FM-index over integer sequences in NumPy: suffix order, wavelet matrix, batched search and locate."""

from __future__ import annotations

import numpy as np

from ephemera.llm.common import U64, ragged


class BitVector:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Rank and access on a sequence of symbols below ``1 << levels``, in one step per level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1 == 1
            self.rows.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.start = np.searchsorted(self._keys(symbols), self._keys(np.arange(1 << levels)))

    def _keys(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols with their bits reversed: the order in which the last level holds them."""
        out = np.zeros(len(symbols), np.int64)
        for level in range(self.levels):
            out |= ((symbols >> level) & 1) << (self.levels - 1 - level)
        return out

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before place ``i``."""
        for row, zeros, level in zip(self.rows, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            ones = row.rank1(i)
            i = np.where((symbol >> level) & 1 == 1, zeros + ones, i - ones)
        return i - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its rank before ``i``."""
        symbol = np.zeros(len(i), np.int64)
        for row, zeros in zip(self.rows, self.zeros, strict=True):
            ones = row.rank1(i)
            bit = row.rank1(i + 1) - ones
            i = np.where(bit == 1, zeros + ones, i - ones)
            symbol = symbol * 2 + bit
        return symbol, i - self.start[symbol]


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s``, whose last symbol is 0; each 0 is smaller than all else and ends a comparison.

    Prefix doubling: suffixes still tied are sorted by the rank of what follows; zeros rank by place.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    sorted_s = s[order]
    new = np.concatenate([[True], (sorted_s[1:] != sorted_s[:-1]) | (sorted_s[1:] == 0)])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    size = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
    tied = order[size > 1]
    step = 1
    while len(tied):
        own, then = rank[tied], rank[tied + step]
        sort = np.argsort(own * n + then)
        tied, own, then = tied[sort], own[sort], then[sort]
        group = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        fresh = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])]))
        of_group = np.repeat(group, np.diff(np.append(group, len(tied))))
        sizes = np.diff(np.append(fresh, len(tied)))
        rank[tied] = own + np.repeat(fresh, sizes) - of_group
        tied = tied[np.repeat(sizes, sizes) > 1]
        step *= 2
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Index of runs of symbols from 1 up, each run closed by a 0."""

    def __init__(self, s: np.ndarray, alphabet: int, rate: int = 8):
        sa = suffix_order(s)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=alphabet + 1))])
        self.bwt = WaveletMatrix(s[sa - 1], max(1, int(alphabet).bit_length()))
        zero = np.flatnonzero(s == 0)
        in_run = np.arange(len(s)) - np.concatenate([[0], zero + 1])[np.searchsorted(zero, np.arange(len(s)))]
        # the start of each run is sampled, so a walk to the left ends before it leaves its run
        marked = in_run[sa] % rate == 0
        self.marked, self.samples = BitVector(marked), sa[marked]
        self.mark = marked

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (a row each): their row intervals."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.counts[-1], np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            a, b = self.counts[c] + self.bwt.rank(c, lo[live]), self.counts[c] + self.bwt.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffix rows: walk to the left to the nearest sampled suffix."""
        out, steps = np.empty(len(rows), np.int64), 0
        at, left = rows, np.arange(len(rows))
        while len(left):
            hit = self.mark[at]
            out[left[hit]] = self.samples[self.marked.rank1(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            symbol, before = self.bwt.access(at)
            at = self.counts[symbol] + before
            steps += 1
        return out

    def occurrences(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern index, place) of every occurrence."""
        lo, hi = self.search(patterns)
        n = np.maximum(hi - lo, 0)
        return np.repeat(np.arange(len(patterns)), n), self.locate(ragged(lo, n))
