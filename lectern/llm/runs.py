"""Maximal runs of consecutive words, by the linear method of Gusfield and Stoye for tandem repeats.

The words of the texts of a slice are one string, with a symbol of its own after every text, so nothing reaches from one text into
another. Then, over that string:

1. Lempel-Ziv blocks give a leftmost-covering set: squares (start, period), found by common extensions at the ends of blocks, such that
   the first occurrence of every square follows one of them through rotations that are squares too.
2. Their places in the suffix tree, here the intervals of a suffix array with common prefixes, are marked.
3. Walks along suffix links, from a marked square to its next rotation, mark the rest of the vocabulary; a walk ends at a
   marked place or where no text goes on with the rotation. Links that the text at hand itself shows are taken all at once.
4. The leaves below a marked place are the square's occurrences. Those of one period at consecutive words merge to a run.

Only squares whose root is no power are kept, so a run's period is its smallest. A common extension takes logarithmic time, from the ranks
of all stretches of 2**k words. Texts that cannot hold a run are left out before: of a run of length L and period q, each three words from place
q on stand q words earlier too, so a streak of L - q - 2 places must have an equal triple at most q words back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernel as K
from .divergence import words_of

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Extensions that are computed, and words that are joined, at a time.
CHUNK = 1 << 18
AS_IS = np.arange(256, dtype=np.uint8)


class Extensions:
    """Suffix array of ``s``, whose last symbol is unique, and longest common extensions to the right and to the left."""

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.rank = [rank.astype(np.int32)]
        while rank.max() < n - 1:
            width = 1 << (len(self.rank) - 1)
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            self.rank.append(rank.astype(np.int32))
        self.place = self.rank.pop()  # of each suffix among all, which no two share
        self.sa = np.empty(n, dtype=np.int64)
        self.sa[self.place] = np.arange(n)
        common = np.zeros(n, dtype=np.int32)
        for a in range(1, n, CHUNK):
            b = min(n, a + CHUNK)
            common[a:b] = self.right(self.sa[a - 1 : b - 1], self.sa[a:b])
        self.common = [common]  # level k: least of 2**k neighbours' common prefixes
        while (width := 1 << len(self.common)) <= n:
            last = self.common[-1]
            self.common.append(np.minimum(last[: n - width + 1], last[width // 2 : n - width // 2 + 1]))

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree from i and j on, for i != j."""
        i, j = i.copy(), j.copy()
        begun = i.copy()
        for k in range(len(self.rank) - 1, -1, -1):
            step = (self.rank[k][i] == self.rank[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - begun

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree from i and j backwards, for i != j; a place of -1 agrees with none."""
        i, j = i.copy(), j.copy()
        begun = i.copy()
        for k in range(len(self.rank) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            fits = (a >= 0) & (b >= 0)
            step = (fits & (self.rank[k][np.maximum(a, 0)] == self.rank[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return begun - i

    def interval(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that begin with the ``length`` symbols at ``at``: their place in the suffix tree."""
        lo = self.place[at].astype(np.int64)
        hi = lo.copy()
        for k in range(len(self.common) - 1, -1, -1):
            level, width = self.common[k], 1 << k
            down = lo - width + 1
            fits = (down >= 1) & (level[np.clip(down, 0, len(level) - 1)] >= length)
            lo -= fits.astype(np.int64) << k
            up = hi + 1
            fits = (hi + width < self.n) & (level[np.clip(up, 0, len(level) - 1)] >= length)
            hi += fits.astype(np.int64) << k
        return lo, hi


def blocks(x: Extensions) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end: a block is the longest stretch that also begins earlier, or one symbol."""
    before, after = [-1] * x.n, [-1] * x.n  # nearest ranks on both sides whose suffix begins earlier
    open_: list[int] = []
    for p in x.sa.tolist():
        while open_ and open_[-1] > p:
            after[open_.pop()] = p
        if open_:
            before[p] = open_[-1]
        open_.append(p)
    longest = np.zeros(x.n, dtype=np.int64)
    for near in (np.array(before), np.array(after)):
        has = np.flatnonzero(near >= 0)
        for a in range(0, len(has), CHUNK):
            i = has[a : a + CHUNK]
            longest[i] = np.maximum(longest[i], x.right(i, near[i]))
    found, at, steps = [], 0, np.maximum(longest, 1).tolist()
    while at < x.n:
        found.append(at)
        at += steps[at]
    return np.array([*found, x.n])


def _counted(many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, 1..many[owner]) in pieces of bounded size, for all owners."""
    ends = np.cumsum(many)
    for a in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        each = np.arange(a, min(a + CHUNK, int(ends[-1])))
        owner = np.searchsorted(ends, each, side="right")
        yield owner, each - (ends - many)[owner] + 1


def covering(x: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of a leftmost-covering set of the squares."""
    edge = blocks(x)
    begin, end = edge[:-1], edge[1:]
    size = end - begin
    after = np.append(size[1:], 0)
    word, starts, periods = x.rank[0] if x.rank else x.place, [], []

    def add(centre: np.ndarray, back: np.ndarray, k: np.ndarray, ok: np.ndarray) -> None:
        starts.append(np.maximum(centre - back, centre - k + 1)[ok])
        periods.append(k[ok])

    # the middle lies in the block, the end beyond it
    for owner, k in _counted(np.where(end < x.n, size, 0)):
        h, q = end[owner], end[owner] - k
        same = word[h] == word[q]
        h, q, k = h[same], q[same], k[same]
        ahead, back = x.right(h, q), x.left(h - 1, q - 1)
        add(q, back, k, ahead + back >= k)
    # the middle lies in the block, the start before it
    for owner, k in _counted(np.minimum(size + after, x.n - 1 - begin)):
        h, q, stop = begin[owner], begin[owner] + k, end[owner]
        same = (h > 0) & (word[h] == word[q]) & (word[h - 1] == word[q - 1])
        h, q, k, stop = h[same], q[same], k[same], stop[same]
        ahead, back = x.right(h, q), x.left(h - 1, q - 1)
        add(h, back, k, (ahead + back >= k) & (np.maximum(h - back, h - k + 1) + k <= stop))
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(periods or [np.zeros(0, np.int64)])


def _primes(most: int) -> np.ndarray:
    sieve = np.ones(most + 1, dtype=bool)
    sieve[:2] = False
    for p in range(2, int(most**0.5) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    return np.flatnonzero(sieve)


def primitive(x: Extensions, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the first half of each square is no power of a shorter stretch."""
    left = np.arange(len(start))  # not yet known to be powers
    for p in _primes(int(period.max(initial=1))):
        i = np.flatnonzero(period[left] % p == 0)
        if len(i):
            at, k = start[left[i]], period[left[i]]
            left = np.delete(left, i[x.right(at, at + k // p) >= k - k // p])
    good = np.zeros(len(start), dtype=bool)
    good[left] = True
    return good


def vocabulary(x: Extensions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, last rank, period) of every distinct square whose root is no power: its place in the suffix tree."""
    start, period = covering(x)
    good = primitive(x, start, period)
    start, period = start[good], period[good]
    marked = np.zeros(0, dtype=np.int64)  # period * n + first rank
    width, word = np.int64(x.n), (x.rank[0] if x.rank else x.place)
    lo, _ = x.interval(start, 2 * period)
    start, period = _once(period * width + lo, start, period)
    while len(start):
        # rotations that the text shows from here on: links taken at once
        further = np.minimum(x.right(start, start + period) - period, period - 1)
        fresh = [np.zeros(0, dtype=np.int64)]
        for owner, step in _counted(further + 1):
            at, k = start[owner] + step - 1, period[owner]
            fresh.append(np.unique(k * width + x.interval(at, 2 * k)[0]))
        marked = np.union1d(marked, np.concatenate(fresh))
        # one link more, to where another text may go on: all but the first word, then that word
        walking = further < period - 1
        last, k = (start + further)[walking], period[walking]
        lo, hi = x.interval(last + 1, 2 * k - 1)
        wanted, end = word[last], hi + 1
        while (open_ := lo < end).any():  # the first suffix of the interval whose next word is not less
            mid = (lo + end) // 2
            less = word[np.minimum(x.sa[np.minimum(mid, x.n - 1)] + 2 * k - 1, x.n - 1)] < wanted
            lo, end = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, end)
        at = x.sa[np.minimum(lo, x.n - 1)]
        goes = (lo <= hi) & (word[np.minimum(at + 2 * k - 1, x.n - 1)] == wanted)
        at, k = at[goes], k[goes]
        key = k * width + x.interval(at, 2 * k)[0]
        new = ~np.isin(key, marked)
        start, period = _once(key[new], at[new], k[new])
    period, lo = marked // width, marked % width
    return lo, x.interval(x.sa[lo], 2 * period)[1], period


def _once(key: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    first = np.unique(key, return_index=True)[1]
    return [c[first] for c in columns]


def maximal_runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of ``s`` with two periods at least, in order of period and start."""
    x = Extensions(np.append(s, s.max(initial=-1) + 1))
    if not x.rank:  # all symbols differ
        return (np.zeros(0, dtype=np.int64),) * 3
    lo, hi, period = vocabulary(x)
    keys = [np.zeros(0, dtype=np.int64)]
    for owner, step in _counted(hi - lo + 1):
        keys.append(period[owner] * x.n + x.sa[lo[owner] + step - 1])
    found = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.diff(found, prepend=-2) != 1)
    last = np.append(first[1:], len(found)) - 1
    q = found[first] // x.n
    return found[first] % x.n, last - first + 2 * q if len(first) else q, q


def may_repeat(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts that may hold a run of LEAST_WORDS and LEAST_PERIODS; all others hold none."""
    n, out = len(ids), np.zeros(len(first) - 1, dtype=bool)
    if n < LEAST_WORDS:
        return out
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    h = K.mix(doc.astype(np.uint64))
    for j in range(3):  # equal triples of a text have equal hashes; others may, which costs time only
        h[: n - j] += ids[j:].astype(np.uint64) * K.STEP[j]
    h = K.mix(h)
    order = np.argsort(h, kind="stable")
    back = np.full(n, n, dtype=np.int64)
    same = h[order][1:] == h[order][:-1]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    for j in (1, 2):  # triples that leave their text
        back[first[1:][counts >= j] - j] = n
    period = 1
    while LEAST_PERIODS * (period // 2 + 1) <= counts.max(initial=0):
        least = period // 2 + 1  # of the periods up to this power of two, beyond the last
        need = max(LEAST_WORDS, LEAST_PERIODS * least) - least - 2
        breaks = np.flatnonzero(back > period)
        streak = np.diff(np.append(breaks, n)) - 1
        out[doc[breaks[streak >= need]]] = True
        period *= 2
    return out


class Slice:
    """Runs of the texts of a slice, after the stated texts have been made to repeat."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, marks: list[int | None]):
        w = K.Words(data, offs, fold=AS_IS, hashed=False)
        codes = words_of(data, offs, K.SPACE, AS_IS)[0].indices.to_numpy().astype(np.int64)
        self.data, self.begin, self.end, self.first = data, w.start, w.end, w.first
        self.word = np.arange(len(codes))
        for d, h in enumerate(marks):
            n, at = int(w.first[d + 1] - w.first[d]), int(w.first[d])
            if h is not None and h % 10 == 0 and n:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                self.word[at + a : at + n] = at + a + np.arange(n - a) % p
        ids = codes[self.word]
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in marks]
        chosen = np.flatnonzero(may_repeat(ids, self.first))
        if not len(chosen):
            return
        top, parts, starts, at = int(ids.max()) + 1, [], [], 0
        for i, d in enumerate(chosen):
            part = ids[self.first[d] : self.first[d + 1]]
            parts += [part, np.array([top + i])]
            starts.append(at)
            at += len(part) + 1
        start, length, period = maximal_runs(np.concatenate(parts))
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        start, length, period = start[long], length[long], period[long]
        owner = np.searchsorted(starts, start, side="right") - 1
        for o, s, n, q in zip(owner.tolist(), (start - np.array(starts)[owner]).tolist(), length.tolist(), period.tolist()):
            self.runs[chosen[o]].append((s, n, q))
        for found in self.runs:
            found.sort(key=lambda r: (r[0], r[2]))

    def collapsed(self) -> list[str]:
        """SHA-256 of each text's words, joined by one space, without those after the first period of any run."""
        keep = np.ones(len(self.word), dtype=bool)
        for d, found in enumerate(self.runs):
            for s, n, q in found:
                keep[self.first[d] + s + q : self.first[d] + s + n] = False
        kept = np.flatnonzero(keep)
        bounds = np.searchsorted(kept, self.first)
        sums = [hashlib.sha256() for _ in self.runs]
        for a in range(0, len(kept), CHUNK):
            word = self.word[kept[a : a + CHUNK]]
            size = self.end[word] - self.begin[word] + 1
            to = np.cumsum(size)
            # each word and the byte after it, which becomes the space
            at = np.arange(int(to[-1])) + np.repeat(self.begin[word] - (to - size), size)
            out = self.data[np.minimum(at, len(self.data) - 1)]
            out[to - 1] = 32
            to = np.append(0, to)
            b = a + len(word)
            for d in range(int(np.searchsorted(bounds, a, side="right")) - 1, len(sums)):
                lo, hi = max(a, int(bounds[d])), min(b, int(bounds[d + 1]))
                if bounds[d] >= b:
                    break
                if lo < hi:
                    sums[d].update(out[to[lo - a] : to[hi - a] - (hi == bounds[d + 1])])
        return [s.hexdigest() for s in sums]


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length for its period; of equal ones the first, then that of the least period."""
    top = None
    for s, n, q in found:
        if top is None or n * top[2] > top[1] * q:
            top = (s, n, q)
    return top


OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OUT of every row of (doc_id, mark, text)."""
    for batch in batches:
        marks = batch.column(1).to_pylist()
        for lo, hi, data, offs in K.slices(batch.column(2)):
            found = Slice(data, offs, marks[lo:hi])
            tops = [best(r) for r in found.runs]
            longs = [[len(r) for r in found.runs], *[[t and t[i] for t in tops] for i in range(3)], [t and 1000 * t[1] // t[2] for t in tops]]
            listed = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in found.runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in longs], pa.array(listed), pa.array(found.collapsed())],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )


def periodic_runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """OUT for every row of ``docs`` (doc_id, text): its runs of LEAST_WORDS words and LEAST_PERIODS periods or more.

    Words are the stretches between white space of ASCII. Of doc_ids whose CRC-32 ends in 0, the text's end is made to repeat first,
    as the contract of the query states; a null doc_id is not. Null, empty and blank texts have no words and no runs: four nulls, and the digests of
    the empty text. Ties between runs go to the first, then to the least period. Repeated rows are each reported; no rows give none; other columns are ignored.
    A text is held whole by its task, with some 300 bytes for each of its words if it may hold a run.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("doc_id").cast("long").cast("string")).alias("mark"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_rows, OUT)
