"""Vectorised hashing of text columns inside tasks (numpy over Arrow buffers).

A batch's texts are handled in slices of about ``SLICE`` bytes (a longer text is a slice of
its own), so memory is a small multiple of the slice or of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + 64)
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit words (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not len(column):
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the number of the first word (one more entry at the end)."""
    solid = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[1:] = solid[:-1]
    cuts = offsets[(offsets < len(data))]
    before[:1] = False
    before[cuts] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = solid[1:]
    after[-1:] = False
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hash, one longer than ``data``."""
    fw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * fw[:len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same wherever the span stands."""
    _, inv = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and per text the number of its first word."""
    if lower:
        data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    return span_hashes(prefix_sums(data), starts, ends), first


def shingle_sets(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word runs; fewer words: the whole sequence as one; none: empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(k, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _BASE + words[i:len(words) - n + 1 + i]
    return np.unique(mix(h))
