"""Monotone sequences and n-gram levels in little space, read through a memory map."""

from __future__ import annotations

import tempfile

import numpy as np

#: Words of 64 bits in a block of the bit vector; the directory has one count a block.
BLOCK = 8
#: Queries answered at once, so that temporary arrays stay small.
AT_ONCE = 1 << 15


class EliasFano:
    """An ascending sequence: the low bits of each element packed, the high parts as a bit vector in which element i sets bit high + i.

    An element takes its low bits, log2(universe / n) of them, about 2 bits of the vector and 1/8
    bit of a directory that counts the zeros before each block of 512 bits. Positions of ones and
    zeros are found from the directory (select). The arrays lie in memory-mapped files that go when
    they are closed.
    """

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.low_bits = max(0, max(1, universe // max(1, self.n)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.top = int(universe >> self.low_bits) + 1
        size = -(-(self.n + self.top + 1) // (64 * BLOCK)) * 64 * BLOCK
        bits = np.zeros(size, bool)
        bits[high + np.arange(self.n)] = True
        words = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.zeros(size // (64 * BLOCK) + 1, np.int64)
        np.cumsum(64 * BLOCK - np.bitwise_count(words).reshape(-1, BLOCK).sum(1, dtype=np.int64), out=zeros[1:])
        self.words, self.zeros, self.low = mapped(words), mapped(zeros), mapped(self._packed(values))

    def _packed(self, values: np.ndarray) -> np.ndarray:
        """The low bits of all values, one after the other, and a word more."""
        out = np.zeros(-(-self.n * self.low_bits // 64) + 2, np.uint64)
        at = np.arange(self.n, dtype=np.int64) * self.low_bits
        low = values & np.uint64((1 << self.low_bits) - 1)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, low << shift)
        over = np.flatnonzero(shift + np.uint64(self.low_bits) > np.uint64(64))
        np.bitwise_or.at(out, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return out

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.zeros.nbytes + self.low.nbytes

    def lows(self, at: np.ndarray) -> np.ndarray:
        """The low bits of the elements at the given indexes."""
        bit = at.astype(np.int64) * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > np.uint64(64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """The position of the rank-th one or zero of the bit vector."""
        before = np.arange(len(self.zeros)) * 64 * BLOCK - self.zeros if one else self.zeros
        out = np.empty(len(rank), np.int64)
        for a in range(0, len(rank), AT_ONCE):
            r = rank[a : a + AT_ONCE].astype(np.int64)
            block = np.searchsorted(before, r, "right") - 1
            words = self.words[block[:, None] * BLOCK + np.arange(BLOCK)]
            words = words if one else ~words
            r = r - before[block]
            upto = np.cumsum(np.bitwise_count(words), 1, dtype=np.int64)
            word = (upto <= r[:, None]).sum(1)
            rows = np.arange(len(r))
            r -= np.where(word > 0, upto[rows, word - 1], 0)
            bits = np.unpackbits(np.ascontiguousarray(words[rows, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bit = (np.cumsum(bits, 1, dtype=np.uint8) <= r[:, None]).sum(1)
            out[a : a + AT_ONCE] = (block * BLOCK + word) * 64 + bit
        return out

    def begin(self, high: np.ndarray) -> np.ndarray:
        """The index of the first element with this high part or more."""
        out = np.zeros(len(high), np.int64)
        later = np.flatnonzero(high > 0)
        out[later] = self._select(high[later] - 1, False) - (high[later] - 1)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The elements at the given indexes."""
        high = self._select(at, True) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(at)

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """The index of the first element that is at least each key."""
        high = np.minimum((keys >> np.uint64(self.low_bits)).astype(np.int64), self.top - 1)
        a, b = self.begin(high), self.begin(high + 1)
        low = keys & np.uint64((1 << self.low_bits) - 1)
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) // 2
            less = self.lows(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        return a


def mapped(values: np.ndarray) -> np.ndarray:
    """The same values, read from a nameless file."""
    if not values.size:
        return values
    with tempfile.TemporaryFile() as f:
        values.tofile(f)
        f.flush()
        return np.memmap(f, values.dtype, "r", shape=values.shape)
