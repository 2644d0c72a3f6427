"""Elias-Fano sequences and a two-level n-gram trie on them, with vectorised lookups.

Elias (1974) and Fano (1971) for the coding; Pibiri and Venturini, "Efficient
Data Structures for Massive N-Gram Datasets", SIGIR 2017, for the trie: the
words under each node are coded relative to the node, so that a level is one
monotone sequence and a lookup is a successor search inside the node's range.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

_ONE, _63 = np.uint64(1), np.uint64(63)


class _Bits:
    """A bit vector with select; a count of ones precedes each word of 64."""

    def __init__(self, words: np.ndarray):
        self.words = words
        counts = np.bitwise_count(words)
        self.ones = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def select(self, k: np.ndarray, bit: bool) -> np.ndarray:
        """Positions of the k-th (from 0) bits of that kind."""
        before = self.ones if bit else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        left = (k - before[word]).astype(np.uint64)
        bits = self.words[word] if bit else ~self.words[word]
        at = np.zeros(len(k), dtype=np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((bits >> at) & np.uint64((1 << width) - 1)).astype(np.uint64)
            over = left >= low
            left = np.where(over, left - low, left)
            at = np.where(over, at + np.uint64(width), at)
        return word * 64 + at.astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of unsigned values: low bits as they are, high bits in unary."""

    def __init__(self, values: np.ndarray, levels: Levels):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        shift = np.uint64(self.low_bits)
        kind = next(t for t, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if self.low_bits <= b)
        self.low = levels.store((values & np.uint64((1 << self.low_bits) - 1)).astype(kind))
        high = (values >> shift).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if self.n else 0
        words = np.zeros((self.n + self.buckets + 64) // 64, dtype=np.uint64)
        at = high + np.arange(self.n)
        np.bitwise_or.at(words, at >> 6, _ONE << (at.astype(np.uint64) & _63))
        self.bits = _Bits(levels.store(words))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self.bits.select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.low[i].astype(np.uint64)

    def find(self, value: np.ndarray, start: np.ndarray | int = 0, stop: np.ndarray | int | None = None) -> np.ndarray:
        """The place of each value inside start..stop, -1 where it isn't: the successor's place, if it is equal."""
        out = np.full(len(value), -1, dtype=np.int64)
        if not self.n or not len(value):
            return out
        value = value.astype(np.uint64)
        high = (value >> np.uint64(self.low_bits)).astype(np.int64)
        asked = np.flatnonzero((high < self.buckets) & (high >= 0))
        if not len(asked):
            return out
        high = high[asked]
        low = (value[asked] & np.uint64((1 << self.low_bits) - 1)).astype(self.low.dtype)
        first = np.where(high > 0, self.bits.select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        end = self.bits.select(high, False) - high
        at = np.maximum(first, start if np.isscalar(start) else start[asked])
        end = np.minimum(end, self.n if stop is None else stop[asked])
        while len(asked):
            alive = at < end
            asked, at, end, low = asked[alive], at[alive], end[alive], low[alive]
            here = self.low[at]
            hit = here == low
            out[asked[hit]] = at[hit]
            on = here < low
            asked, at, end, low = asked[on], at[on] + 1, end[on], low[on]
        return out


class Quantised:
    """Real values as places in a uniform codebook of 65,536 entries."""

    def __init__(self, values: np.ndarray, levels: Levels):
        self.low = float(values.min()) if len(values) else 0.0
        self.step = max((float(values.max()) - self.low) / 65535, 1e-12) if len(values) else 1.0
        self.codes = levels.store(np.rint((values - self.low) / self.step).astype(np.uint16))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.low + self.codes[i] * self.step


class Levels:
    """Arrays in one memory-mapped file, which has no name any more and goes with its last mapping."""

    def __init__(self) -> None:
        handle, self._path = tempfile.mkstemp()
        self._file = os.fdopen(handle, "r+b")
        os.unlink(self._path)

    def store(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return values
        self._file.seek(0, os.SEEK_END)
        self._file.write(b"\0" * (-self._file.tell() % 64))
        at = self._file.tell()
        self._file.write(np.ascontiguousarray(values).tobytes())
        self._file.flush()
        return np.memmap(self._file, dtype=values.dtype, mode="r", offset=at, shape=values.shape)


class BigramTrie:
    """Words, and under each word the words seen before it, with quantised logarithms.

    words: ascending distinct 64-bit keys; totals: their counts; owner, before,
    counts: for each pair the word's place, the 32-bit key of the word before (ascending
    within the word) and the pair's count. p1: the words' unsmoothed share.
    The pair level is the sequence owner * 2**32 + before.
    """

    def __init__(self, words: np.ndarray, totals: np.ndarray, owner: np.ndarray, before: np.ndarray, counts: np.ndarray, p1: np.ndarray, strength: float):
        levels = Levels()
        self.words = EliasFano(words, levels)
        self.totals = levels.store(totals)
        starts = np.searchsorted(owner, np.arange(len(words) + 1))
        self.pointers = EliasFano(starts, levels)
        self.pairs = EliasFano(owner.astype(np.uint64) << np.uint64(32) | before.astype(np.uint64), levels)
        self.alone = Quantised(np.log10(p1), levels)
        self.context = Quantised(np.log10(totals + strength), levels)
        self.smoothed = Quantised(np.log10(counts + strength * p1[owner]), levels)

    def word(self, keys: np.ndarray) -> np.ndarray:
        return self.words.find(keys)

    def pair(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """word: places of known words."""
        start, stop = (self.pointers[word + k].astype(np.int64) for k in (0, 1))
        return self.pairs.find(word.astype(np.uint64) << np.uint64(32) | before.astype(np.uint64), start, stop)
