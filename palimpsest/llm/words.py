"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``.  These separators are
ASCII, so the split can be made on UTF-8 bytes without decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_M1 = U64(0xBF58476D1CE4E5B9)
_M2 = U64(0x94D049BB133111EB)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (splitmix64) on unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, one after the other, and offsets (one more than values); a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of the first word of each value (one more than values)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each slice of ``data``; equal slices have equal hashes whatever surrounds them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    length = ends - starts
    h = length.astype(U64) * _GOLDEN + U64(seed)
    todo, at = np.flatnonzero(length > 0), 0
    while len(todo):
        left = length[todo] - at
        lane = lanes[starts[todo] + at]
        part = np.minimum(left, 8).astype(U64)
        lane &= U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - part * U64(8))
        h[todo] = mix64(h[todo] * _GOLDEN ^ lane)
        todo, at = todo[left > 8], at + 8
    return h


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of "a, then b"; not symmetric."""
    x = a * _M1
    x ^= x >> U64(32)
    x += b
    x *= _M2
    x ^= x >> U64(29)
    return x


def windows(keys: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive keys, and which of those windows lie in one value."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    out, done, level, size = np.full(n, U64(seed) * _GOLDEN + U64(width), U64), 0, keys, 1
    while True:  # the width in binary: hashes of 1, 2, 4, ... keys
        if width & size:
            out = join_hashes(out, level[done : done + n])
            done += size
        if size * 2 > width:
            break
        level = join_hashes(level[:-size], level[size:])
        size *= 2
    value = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix64(out), value[:n] == value[width - 1 :]
