"""Vectorised text kernels over Arrow string columns.

All functions work on the raw UTF-8 buffers of an Arrow array with numpy, in slices of bounded
size, so neither batch length nor text length sets the memory. Words are ``[^\\x20\\x09-\\x0D]+`` with
A-Z lowered, hashed to 64 bits; n-grams are hashes of word hashes and never cross a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit constants."""
    x = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)
    return mix(mix(x)) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE = constants(256, 11)
STEP = constants(64, 23)
LENGTH_SALT = constants(64, 37)
_power = np.ones(1, dtype=_U)


def powers(n: int) -> np.ndarray:
    """First n powers of a fixed odd base, modulo 2**64."""
    global _power
    if len(_power) < n:
        steps = np.full(max(n, 2 * len(_power)), _U(0xD6E8FEB86659FD93), dtype=_U)
        steps[0] = _U(1)
        _power = np.cumprod(steps, dtype=_U)
    return _power[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offs


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) with at most ``limit`` bytes unless one text is longer."""
    data, offs = buffers(column)
    start, n = 0, len(offs) - 1
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n, start + 20_000)
        yield start, end, data[offs[start] : offs[end]], offs[start : end + 1] - offs[start]
        start = end


class Words:
    """Word hashes of a slice: ``hash``, unless not ``hashed``; document d owns words ``first[d]:first[d + 1]``; byte ``start`` and ``end`` of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE, fold: np.ndarray = LOWER, hashed: bool = True):
        inside = ~separator[data]
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            edges = offs[(offs > 0) & (offs < len(data))]
            before[edges] = False
            after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        if not len(self.start) or not hashed:
            self.hash = np.zeros(0, dtype=_U)
            return
        lens = self.end - self.start
        at = np.cumsum(lens) - lens
        flat = fold[data[inside]]
        pos = np.arange(len(flat), dtype=np.int64) - np.repeat(at, lens)
        power = powers(int(lens.max()))
        self.hash = mix(np.add.reduceat(BYTE[flat] * power[pos], at) + lens.astype(_U) * LENGTH_SALT[0])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first) of the word n-grams in text order; with ``whole_if_short`` a text of 1 to n-1 words has its whole sequence as one."""
        total, counts = len(self.hash), self.counts
        if not total:
            return np.zeros(0, dtype=_U), np.zeros(len(counts) + 1, dtype=np.int64)
        acc = np.zeros(total, dtype=_U)
        for j in range(min(n, total)):
            acc[: total - j] += self.hash[j:] * STEP[j]
        left = np.repeat(self.first[1:], counts) - np.arange(total)  # words from here to the end of the text
        keep = left >= n
        many = np.maximum(counts - n + 1, 0)
        if whole_if_short:
            for d in np.flatnonzero((counts > 0) & (counts < n)):
                a, c = self.first[d], counts[d]
                acc[a : a + 1] = (self.hash[a : a + c] * STEP[:c]).sum(dtype=_U) + LENGTH_SALT[c : c + 1]
                keep[a], many[d] = True, 1
        return mix(acc[keep]), np.concatenate([[0], np.cumsum(many)]).astype(np.int64)


def distinct_sets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, concatenated, and their bounds."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=_U)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def lists(values: np.ndarray, width: int) -> pa.Array:
    """An Arrow list<int64> column of equally long lists."""
    rows = values.size // width
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1).view(np.int64)))
