"""Vectorised views of Arrow string columns: bytes, words and word hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240501)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xFF51AFD7ED558CCD)

#: Words are runs of bytes other than space and 0x09-0x0D.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters and digits and of bytes of other scripts.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[128:] = True
for _lo, _hi in (("0", "9"), ("A", "Z"), ("a", "z")):
    ALNUM_WORD[ord(_lo) : ord(_hi) + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of whole documents of about `most` bytes; a longer document is a run of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of the words; off[0] must be 0."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.concatenate(([False], w[:-1])) & ~cut[:-1]
    after = np.concatenate((w[1:], [False])) & ~cut[1:]
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], by position-weighted sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(total[-1]) - np.repeat(total[:-1], size)
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(size.max()) - 1, BASE))))
    at = place + np.repeat(starts, size)
    return mix(np.add.reduceat(BYTE_CODE[data[at]] * power[place], total[:-1]) + size.astype(np.uint64))


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of n words within a document."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = h[:m].copy()
    for k in range(1, n):
        g = g * BASE + h[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(g[at]), at
