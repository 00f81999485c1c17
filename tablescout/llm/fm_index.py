"""An FM-index over a sequence of small numbers: wavelet ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text are kept for locating.
SAMPLE = 16


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        part = self.words[word] & ((np.uint64(1) << low) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Ranks of symbols: one level for each bit of a symbol, zeros moved before ones from level to level."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (alphabet - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1 == 1
            zeros = symbols[~bits]
            self.levels.append((shift, Bits(bits), len(zeros)))
            symbols = np.concatenate([zeros, symbols[bits]])
        every = np.arange(alphabet)
        self.first = self._down(every, np.zeros(alphabet, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbols >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbols, at) - self.first[symbols]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbols = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbols |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at - self.first[symbols]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text that ends with its only 0, by doubling; places that are settled rest."""
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(starts, len(text)))
    rank = np.empty(len(text), np.int64)
    rank[order] = np.repeat(starts, sizes)
    open_at = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    step = 1
    while len(open_at):
        suffix = order[open_at]
        key, group = rank[suffix + step], rank[suffix]
        by = np.lexsort((key, group))
        suffix, key, group = suffix[by], key[by], group[by]
        order[open_at] = suffix
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(suffix)))
        rank[suffix] = np.repeat(open_at[starts], sizes)
        open_at = open_at[np.repeat(sizes, sizes) > 1]
        step *= 2
    return order


class FMIndex:
    """Counts and places of phrases in a text of numbers from 1 to ``alphabet - 1``."""

    def __init__(self, text: np.ndarray, alphabet: int):
        text = np.append(text, 0)
        order = suffix_array(text)
        self.wavelet = Wavelet(text[order - 1], alphabet)
        self.smaller = np.zeros(alphabet + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=alphabet), out=self.smaller[1:])
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = Bits(sampled), order[sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of each phrase; phrases are rows of symbols, filled up on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for back in range(width):
            going = np.flatnonzero((lengths > back) & (low < high))
            if not len(going):
                break
            symbol = phrases[going, width - 1 - back]
            low[going] = self.smaller[symbol] + self.wavelet.rank(symbol, low[going])
            high[going] = self.smaller[symbol] + self.wavelet.rank(symbol, high[going])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text until one whose position is kept."""
        places = np.empty(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            there = self.sampled.get(rows)
            places[left[there]] = self.samples[self.sampled.ones(rows[there])] + steps
            left, rows = left[~there], rows[~there]
            symbols, before = self.wavelet.read(rows)
            rows, steps = self.smaller[symbols] + before, steps + 1
        return places
