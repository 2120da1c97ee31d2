"""A wavelet matrix over small symbols, with many rank queries answered at once."""

from __future__ import annotations

import numpy as np

_WORD = 64


class _Bits:
    """A bit vector with the number of ones before any place: a total for each word, and a count within it."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // _WORD + 1, np.uint64)  # a last word that is never full, so that rank(len) has one
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])

    def rank(self, place: np.ndarray) -> np.ndarray:
        word, bit = place // _WORD, (place % _WORD).astype(np.uint64)
        lower = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(lower).astype(np.int64)


class WaveletMatrix:
    """The symbols 0 .. 2**bits - 1 of a sequence, one bit vector a level, the highest bit first.

    Each level is stably parted into its zeros and its ones; a rank goes down the levels with
    its place, so it costs one bit count for each of them whatever the length of the sequence.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[_Bits, int]] = []
        for shift in reversed(range(bits)):
            ones = (symbols >> shift & 1).astype(bool)
            self.levels.append((_Bits(ones), len(symbols) - int(np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.size = len(symbols)

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each of ``places`` (0 .. length)."""
        start, stop = np.zeros_like(places), places
        for level, (ones, zeros) in enumerate(self.levels):
            first, last = ones.rank(start), ones.rank(stop)
            if symbol >> (len(self.levels) - 1 - level) & 1:
                start, stop = zeros + first, zeros + last
            else:
                start, stop = start - first, stop - last
        return stop - start
