"""Vectorised text kernels over Arrow buffers: words, word hashes and n-gram hashes.

Everything works on the UTF-8 bytes of a whole slice of documents at once, so no
Python object is made per word. A word is a run of ASCII letters, digits,
underscores and non-ASCII characters. Slices are cut by bytes (``SLICE``), never by
documents, so memory is bounded by the slice or by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time.
SLICE = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

IS_WORD = np.zeros(256, bool)
IS_WORD[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] += _U(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


class _Powers:
    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), SLICE + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_POWERS = _Powers()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes, a longer row alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: each word's first byte, the byte after it and its
    hash (ASCII letters folded), and for each document the index of its first word
    (one more entry than documents)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = inside[cut]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_FOLD[data] * up[:n], out=total[1:])
    value = mix((total[end] - total[begin]) * down[begin])
    return begin, end, value, np.searchsorted(begin, offsets)


def ngrams(value: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words of each document and, for each document, the index
    of its first one. A document of fewer than n words, but one at least, has one."""
    counts = np.diff(bounds)
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    if at[-1] == 0:
        return np.zeros(0, np.uint64), at
    start = np.repeat(bounds[:-1] - at[:-1], size) + np.arange(at[-1])
    have = np.repeat(np.minimum(counts, n), size)
    out = np.zeros(at[-1], np.uint64)
    short = bool((have < n).any())
    for j in range(n):
        if short:
            ok = have > j
            out[ok] = mix(out[ok] * _BASE + value[start[ok] + j] + _U(1))
        else:
            out = mix(out * _BASE + value[start + j] + _U(1))
    return out, at
