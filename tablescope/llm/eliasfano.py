"""Elias-Fano coding of monotone sequences, in numpy, on memory-mapped files.

A sequence of ``n`` values below ``u`` takes about ``2 + log2(u / n)`` bits a
value: the low bits are packed, the high bits are unary with a directory of
zeros.  ``at`` gives values by place, ``successor`` the first place whose value
is not below a bound, both for whole arrays of questions.
"""

from __future__ import annotations

import os

import numpy as np

_ONE = np.uint64(1)
STEP = 1 << 17  #: values that are coded at once, a multiple of 64


def mapped(folder: str, name: str) -> np.ndarray:
    """A stored array, mapped into memory, without the cost of numpy's own class for such arrays."""
    return np.asarray(np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r"))


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of each of ``values`` in 64-bit words, with one spare word."""
    n = len(values)
    if not bits:
        return np.zeros(1, np.uint64)
    packed = np.zeros(-(-n // 64) * bits + 1, np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for a in range(0, n, STEP):
        part = values[a : a + STEP] & mask
        rows = -(-len(part) // 64)
        grid = np.zeros(rows * 64, np.uint64)
        grid[: len(part)] = part
        grid = grid.reshape(rows, 64)
        out = packed[a // 64 * bits :][: rows * bits].reshape(rows, bits)
        for k in range(64):  # 64 values fill ``bits`` words
            word, shift = divmod(k * bits, 64)
            out[:, word] |= grid[:, k] << np.uint64(shift)
            if shift + bits > 64:
                out[:, word + 1] |= grid[:, k] >> np.uint64(64 - shift)
    return packed


class EliasFano:
    """A monotone sequence of unsigned integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        size = n + (top >> low_bits) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        for a in range(0, n, STEP):
            upper = (values[a : a + STEP] >> np.uint64(low_bits)).astype(np.int64)
            bits[upper + np.arange(a, a + len(upper))] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)])
        small = zeros.astype(np.uint32) if zeros[-1] < 2**32 else zeros
        return cls(n, low_bits, _pack(values, low_bits), high, small)

    def save(self, folder: str, name: str) -> None:
        for part in ("low", "high", "zeros"):
            np.save(os.path.join(folder, f"{name}.{part}.npy"), getattr(self, part))
        np.save(os.path.join(folder, f"{name}.size.npy"), np.array([self.n, self.low_bits]))

    @classmethod
    def open(cls, folder: str, name: str) -> EliasFano:
        n, low_bits = np.load(os.path.join(folder, f"{name}.size.npy")).tolist()
        return cls(n, low_bits, *(mapped(folder, f"{name}.{p}") for p in ("low", "high", "zeros")))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.low[word] >> shift
        over = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | over) & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero number ``k`` (from 0) in the unary part."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1  # one type: the directory is not converted
        return (word << 6) + _nth_bit(~self.high[word], (k - self.zeros[word]).astype(np.int64))

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values with these upper bits start and end; both ``n`` beyond the last."""
        last = len(self.high) * 64 - self.n - 1  # the number of the last zero
        over = h > last
        h = np.minimum(h, last)
        first = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1, 0)
        rest = ~self.high[first >> 6] >> (first & 63).astype(np.uint64)
        stop = first + np.bitwise_count((rest & -rest) - _ONE)  # the next zero, if it is in this word
        further = np.flatnonzero(rest == 0)
        stop[further] = self._zero(h[further])
        return np.where(over, self.n, first - h), np.where(over, self.n, stop - h)

    def _search(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places not below ``x`` among those of its upper bits within ``[lo, hi)``, their ends, and the lower bits."""
        start, end = self._bucket((x >> np.uint64(self.low_bits)).astype(np.int64))
        a, end = np.maximum(start, lo), np.minimum(end, hi)
        b = end.copy()
        low = x & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._lows(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        return a, end, low

    def successor(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> np.ndarray:
        """The first place in ``[lo, hi)`` with a value of at least ``x``; ``hi`` if none."""
        x = np.asarray(x, np.uint64)
        hi = np.full(len(x), self.n) if hi is None else np.asarray(hi, np.int64)
        lo = np.broadcast_to(np.asarray(lo, np.int64), x.shape)
        return np.minimum(np.maximum(self._search(x, lo, hi)[0], lo), hi)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values by place."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        ones_before = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros if self._ones is None else self._ones
        self._ones = ones_before
        word = np.searchsorted(ones_before, i, "right") - 1
        place = (word << 6) + _nth_bit(self.high[word], i - ones_before[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)

    _ones: np.ndarray | None = None

    def find(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> np.ndarray:
        """Places of the values ``x`` within ``[lo, hi)``; -1 where absent."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.full(len(x), -1)
        hi = np.full(len(x), self.n) if hi is None else np.asarray(hi, np.int64)
        place, end, low = self._search(x, np.broadcast_to(np.asarray(lo, np.int64), x.shape), hi)
        asked = np.flatnonzero(place < end)  # the upper bits agree there, so the lower ones decide
        found = asked[self._lows(place[asked]) == low[asked]]
        out = np.full(len(x), -1)
        out[found] = place[found]
        return out

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.zeros.nbytes


_EACH = np.uint64(0x0101010101010101)  #: one in each byte
_TOP = np.uint64(0x8080808080808080)
#: place of set bit ``n`` of a byte, at ``8 * byte + n``
_IN_BYTE = np.array([next((p for p in range(8) if b >> p & 1 and (b & (1 << p) - 1).bit_count() == n), 0) for b in range(256) for n in range(8)], np.int64)


def _nth_bit(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of set bit number ``n`` (from 0) of each word."""
    n = n.astype(np.uint64)
    upto = word - ((word >> _ONE) & np.uint64(0x5555555555555555))
    upto = (upto & np.uint64(0x3333333333333333)) + ((upto >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((upto + (upto >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH  # byte by byte, set bits up to its end
    shift = np.bitwise_count((((n * _EACH) | _TOP) - upto) & _TOP).astype(np.uint64) << np.uint64(3)
    inside = n - (((upto << np.uint64(8)) >> shift) & np.uint64(255))
    return shift.astype(np.int64) + _IN_BYTE[((((word >> shift) & np.uint64(255)) << np.uint64(3)) | inside).astype(np.int64)]
