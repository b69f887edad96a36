"""Occurrences of many terms in a text, found together.

Windows of a text are compared with all terms of their length at once: a window's polynomial hash follows from two prefix sums, a table of bits
tells those that no term has, and the bytes of the rest are compared. So the cost follows the number of distinct lengths, hardly that of terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Windows that are looked at together; bits of the table.
BLOCK, TABLE_BITS = 1 << 18, 20
_U = np.uint64
BASE = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(3).integers(1, 2**63, 256, dtype=_U) | _U(1)


class Patterns:
    """Terms, without empty and repeated ones, by their lengths in bytes."""

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted({t for t in terms if t})
        groups: dict[int, list[int]] = {}
        for i, t in enumerate(self.terms):
            groups.setdefault(len(t.encode()), []).append(i)
        self.longest = max(groups, default=0)
        size = BLOCK + self.longest
        step, back = np.full(size, _U(BASE)), np.full(size, _U(pow(BASE, -1, 2**64)))
        step[0] = back[0] = 1
        self.power, self.inverse = np.cumprod(step, dtype=_U), np.cumprod(back, dtype=_U)
        self.groups = []
        for length, ids in sorted(groups.items()):
            body = np.array([list(self.terms[i].encode()) for i in ids], dtype=np.uint8)
            h = (_BYTE[body] * self.power[:length]).sum(axis=1, dtype=_U)
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << TABLE_BITS, dtype=bool)
            table[h >> _U(64 - TABLE_BITS)] = True
            self.groups.append((length, h[order], np.array(ids)[order], body[order], table))

    def matches(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, term) of all occurrences, overlapping ones too, in texts that end at ``ends``: those that begin in a block, for each block."""
        for a in range(0, len(data), BLOCK):
            places, terms = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            part = data[a : a + BLOCK + self.longest]
            sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(_BYTE[part] * self.power[: len(part)], dtype=_U)])
            for length, hashes, ids, body, table in self.groups:
                n = min(BLOCK, len(part) - length + 1)
                if n <= 0:
                    continue
                h = (sums[length : length + n] - sums[:n]) * self.inverse[:n]
                at = np.flatnonzero(table[h >> _U(64 - TABLE_BITS)])
                lo, hi = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], side="right")
                while (more := lo < hi).any():  # terms of one hash, hardly ever more than one
                    at, lo, hi = at[more], lo[more], hi[more]
                    same = np.ones(len(at), dtype=bool)
                    for j in range(length):
                        same &= part[at + j] == body[lo, j]
                    inside = same & (a + at + length <= ends[np.searchsorted(ends, a + at, side="right")])
                    places.append(a + at[inside])
                    terms.append(ids[lo[inside]])
                    lo = lo + 1
            yield np.concatenate(places), np.concatenate(terms)

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences that don't overlap, from the left) of a string column; nulls have none."""
        many = max(1, len(self.terms))
        found = [(text * many + term, n) for text, term, n in self.counted(column)]
        key, at = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[k for k, _ in found]]), return_inverse=True)
        n = np.zeros(len(key), dtype=np.int64)
        np.add.at(n, at, np.concatenate([np.zeros(0, dtype=np.int64), *[x for _, x in found]]))
        return key // many, key % many, n

    def counted(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``counts`` of each block, in order.

        A text that lies in several blocks is in the counts of each. Memory follows the block, whatever the length of the column.
        """
        column = column.cast(pa.large_string())
        offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[offs[0] : offs[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
        offs, many = offs - offs[0], max(1, len(self.terms))
        sizes = np.array([len(t.encode()) for t in self.terms], dtype=np.int64)
        taken = np.zeros(many, dtype=np.int64)  # where the last counted occurrence of each term ends
        for place, term in self.matches(data, offs[1:]):
            if not len(place):
                continue
            order = np.lexsort((place, term))
            place, term = place[order], term[order]
            end = place + sizes[term]
            first = np.diff(term, prepend=-1) != 0
            close = place < np.where(first, taken[term], np.roll(end, 1))
            keep = np.ones(len(place), dtype=bool)
            for i in np.flatnonzero(close).tolist():  # in order, so what stands before i is settled
                j = i
                while not first[j] and (j == i or not keep[j]):
                    j -= 1
                before = end[j] if j < i and keep[j] else taken[term[i]]
                keep[i] = place[i] >= before
            taken[term[keep]] = end[keep]  # of a term's places the last one stays
            text = np.searchsorted(offs[1:], place[keep], side="right")
            key, n = np.unique(text * many + term[keep], return_counts=True)
            yield key // many, key % many, n


def _summed(weights: dict[str, float], kind: pa.DataType, once: bool) -> callable:
    found = Patterns(weights)
    each = np.array([weights[t] for t in found.terms])

    def run(text: pa.Array) -> pa.Array:
        total = np.zeros(len(text), dtype=each.dtype if len(each) else np.int64)
        last, seen = -1, np.zeros(len(each), dtype=bool)  # terms of the last text, which may go on in the next block
        for owner, term, n in found.counted(text):
            if once:
                fresh = ~((owner == last) & seen[term])
                owner, term, n = owner[fresh], term[fresh], 1
                if len(owner):
                    seen &= owner[-1] == last
                    last = owner[-1]
                    seen[term[owner == last]] = True
            np.add.at(total, owner, each[term] * n)
        return pa.array(total, mask=np.asarray(text.is_null())).cast(kind)

    return run


def weighted_occurrences(text: Column, weights: dict[str, int]) -> Column:
    """Sum of weight times occurrences of every term, a whole number; null for null."""
    return F.arrow_udf(_summed(weights, pa.int64(), False), "long")(text)


def weight_of_present(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the terms that occur; null for null."""
    return F.arrow_udf(_summed({t: float(w) for t, w in weights.items()}, pa.float64(), True), "double")(text)
