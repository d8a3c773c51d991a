"""A compressed FM-index over word ids with a wavelet matrix, searched for many patterns at once.

The text and its suffix array are sorted once and not kept.  What stays is the wavelet
matrix of the transformed text (packed bits with running counts), the symbol counts,
and one payload per distinct run of ``depth`` symbols behind a marker bit vector.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a running count per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, dtype=bool)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = int(len(bits) - bits.sum())

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the ``depth`` symbols from each on, and which of them differ from the one before.

    As many ranks as fit 62 bits are compared at once, so the sorted span grows several
    times a round.
    """
    n, span, rank = len(text), 1, text
    order, head = np.arange(n), np.ones(n, dtype=bool)
    while True:
        bits = max(1, int(rank.max() + 1).bit_length())
        each = max(2, 62 // bits)
        offsets = sorted({min(k * span, depth - span) for k in range(each)})
        key = np.zeros(n, dtype=np.int64)
        for offset in offsets:
            key <<= bits
            key[: n - offset] += rank[offset:] + 1
        order = np.argsort(key)
        ordered = key[order]
        head = np.ones(n, dtype=bool)
        head[1:] = ordered[1:] != ordered[:-1]
        span += offsets[-1]
        if span >= depth:
            return order, head
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(head)


class FMIndex:
    """Index of ``text`` (ids from 1; 0 separates passages), sorted to ``depth`` symbols.

    ``payload`` has a number for each position; the index keeps the least of each
    distinct run of ``depth`` symbols.
    """

    def __init__(self, text: np.ndarray, depth: int, payload: np.ndarray):
        order, head = sorted_suffixes(text, depth)
        self.size = len(text)
        self.heads = BitVector(head)
        self.least = np.minimum.reduceat(payload[order], np.flatnonzero(head))
        last = text[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.levels: list[BitVector] = []
        for bit in reversed(range(max(1, int(text.max()).bit_length()))):
            ones = ((last >> bit) & 1).astype(bool)
            self.levels.append(BitVector(ones))
            last = np.concatenate([last[~ones], last[ones]])

    def _ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` stands in the transformed text before ``low`` and before ``high``."""
        first = np.zeros_like(low)
        for depth, bits in enumerate(self.levels):
            one = ((symbol >> (len(self.levels) - 1 - depth)) & 1).astype(bool)
            ones = [bits.ones_before(x) for x in (first, low, high)]
            first, low, high = (np.where(one, bits.zeros + o, x - o) for x, o in zip((first, low, high), ones))
        return low - first, high - first

    def search(self, symbols: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each end: (length matched, first suffix, suffix after the last).

        The length is the matching statistic, up to ``most``; a separator, or a symbol the
        index lacks, ends a match.
        """
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.size, dtype=np.int64)
        length = np.zeros(len(ends), dtype=np.int64)
        live = np.arange(len(ends))
        for k in range(1, most + 1):
            live = live[ends[live] >= k]
            symbol = symbols[ends[live] - k]
            known = (symbol > 0) & (symbol < len(self.less) - 1)
            live, symbol = live[known], symbol[known]
            if k == 1:
                lo, hi = self.less[symbol], self.less[symbol + 1]
            else:
                lo, hi = self._ranks(symbol, low[live], high[live])
                lo, hi = self.less[symbol] + lo, self.less[symbol] + hi
            found = lo < hi
            live = live[found]
            low[live], high[live], length[live] = lo[found], hi[found], k
        return length, low, high

    def least_of(self, low: np.ndarray) -> np.ndarray:
        """The least payload of the run of ``depth`` symbols whose interval begins at ``low``."""
        return self.least[self.heads.ones_before(low)]
