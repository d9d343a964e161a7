"""Words of many texts as byte ranges, cut and hashed in whole arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import HASH_BLOCK, _power_tables, mix

LONG_WORD = 512  #: words of more bytes are hashed one by one


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the bytes of these closed ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: bytes after A-Z are folded to a-z, nothing else
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and per-text offsets of the maximal runs of ``inside`` bytes.

    Text ``i`` is ``data[offsets[i]:offsets[i + 1]]``; its words are
    ``at[i]`` to ``at[i + 1]`` of the third result.  A run ends where its text does.
    """
    n = len(data)
    border = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    starts, ends = [], []
    for a in range(0, n, HASH_BLOCK):
        b = min(n, a + HASH_BLOCK)
        word = inside[data[a:b]]
        before = np.empty(b - a, bool)
        before[1:] = word[:-1]
        before[0] = a > 0 and inside[data[a - 1]]
        cut = np.zeros(b - a, bool)
        cut[border[np.searchsorted(border, a) : np.searchsorted(border, b)] - a] = True
        starts.append(np.flatnonzero(word & (~before | cut)) + a)
        ends.append(np.flatnonzero(before & (~word | cut)) + a)
    if n and inside[data[n - 1]]:
        ends.append(np.array([n]))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return start, end, np.searchsorted(start, offsets, "left")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges that are sorted and do not overlap; another seed is another hash.

    Prefix sums modulo 2**64 over blocks of bytes give all short words in a
    few passes; long ones are hashed one by one.
    """
    out = np.empty(len(start), np.uint64)
    long = end - start > LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    short = np.flatnonzero(~long)
    s, e = start[short], end[short]
    value = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x51) & 0xFFFFFFFFFFFFFFFF))
    k = 0
    while k < len(s):
        j = int(np.searchsorted(s, s[k] + HASH_BLOCK, "left"))
        lo, hi = int(s[k]), int(e[j - 1])
        power, inverse = _power_tables(hi - lo + 1)
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[data[lo:hi]] * power[: hi - lo], out=prefix[1:])
        a, b = s[k:j] - lo, e[k:j] - lo
        out[short[k:j]] = mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64))
        k = j
    return out
