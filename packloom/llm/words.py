"""Words of whole Arrow text columns, as numpy arrays of positions and 64-bit hashes.

A null text counts as an empty one. Work arrays are bounded by ``SLICE`` bytes of text at a time, or
by the longest single text (one byte mask each) where that is longer.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20
_CHUNK = 1 << 20
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWERED = _BYTE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_POW, _INV = _powers(_BASE, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0]: at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes, or of one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end) of every word; a word never spans two texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = letters[data]
    edge = np.empty(len(data), bool)
    edge[0], edge[1:] = True, ~inside[:-1]
    first = offsets[:-1]
    edge[first[first < len(data)]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1], edge[:-1] = True, ~inside[1:]
    filled = offsets[1:][offsets[1:] > offsets[:-1]]
    edge[filled - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, given in order of place: polynomial prefix sums over random byte values."""
    values, out = _LOWERED if lower else _BYTE, np.empty(len(starts), _U)
    a = 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + _CHUNK, "right")))
        n = int(ends[b - 1] - lo)
        pw, iv = (_POW, _INV) if n <= _CHUNK else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
        sums = np.zeros(n + 1, _U)
        np.cumsum(values[data[lo: lo + n]] * pw[:n], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * iv[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
        a = b
    return mix(out)


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])
