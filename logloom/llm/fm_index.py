"""A compressed FM-index over word sequences: bit-packed wavelet tree of the Burrows-Wheeler transform, searched backwards.

Suffixes are sorted by their first ``depth`` symbols, which keeps every range of a pattern of up to that length contiguous and exact.  Searches for many
patterns run in lock-step in numpy, one word further to the left at a time.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Rank of a symbol in a prefix of a sequence: one bit vector per bit of the alphabet, packed, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        now = symbols
        for level in reversed(range(bits)):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((level, words, ones, int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of length ``at`` ends among all occurrences of ``symbol`` at the bottom of the tree."""
        for level, words, ones, zeros in self.levels:
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            one = ones[word] + np.bitwise_count(words[word] & mask)
            at = np.where((symbol >> level) & 1, zeros + one, at - one)
        return at


class FMIndex:
    """Index of ``text``: symbols from 1 on, 0 between (and at the end of) the sequences."""

    def __init__(self, text: np.ndarray, depth: int):
        self.symbols = int(text.max(initial=0)) + 1
        order = _sorted_suffixes(text, depth)
        bits = max(1, int(self.symbols - 1).bit_length())
        self.tree = WaveletTree(text[order - 1], bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.base = self.tree.walk(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of ``symbol`` + pattern from the ranges [lo, hi) of the patterns."""
        ends = self.tree.walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        ends += np.tile(self.first[symbol] - self.base[symbol], 2)
        return ends[: len(symbol)], ends[len(symbol):]

    def matched(self, text: np.ndarray, end: np.ndarray, most: int, least_count: int = 2) -> np.ndarray:
        """Matching statistics: for each end (inclusive) in ``text`` the length, up to ``most``, of the longest sequence ending there that the
        index holds ``least_count`` times."""
        length = np.zeros(len(end), np.int64)
        live = np.arange(len(end))
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.first[-1])
        at = end.copy()
        for _ in range(most):
            lo, hi = self.back(text[at], lo, hi)
            good = (hi - lo >= least_count) & (text[at] > 0)
            live, lo, hi = live[good], lo[good], hi[good]
            if not len(live):
                break
            length[live] += 1
            at = at[good] - 1
        return length


def _sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts by their first ``depth`` symbols or more (prefix doubling), the rest in any order."""
    rank, reach, n = text.astype(np.int64), 1, len(text)
    order = np.argsort(rank)
    while reach < depth:
        other = np.full(n, -1, np.int64)
        other[: max(0, n - reach)] = rank[reach:]
        pair = rank * (n + 1) + other + 1
        order = np.argsort(pair)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        rank, reach = new, 2 * reach
        if n and rank[order[-1]] == n - 1:
            break
    return order
