"""Language-model scores by stupid backoff, leaving each document's own counts out.

S(w | u v) = c(u v w) / c(u v) if c(u v w) > 0, else 0.4 S(w | v); S(w | v) = c(v w) / c(v) if c(v w) > 0, else 0.4 S(w);
S(w) = c(w) / N, or 1 / (N + 1) for a word not seen. Counts c and N are over all other documents: the corpus
count less the document's own (by parameter, over all). The first words of a document use the orders they have, without penalty.

Counting is relational. Every document's n-grams are exploded into rows (n-gram, slice, place, count) with a 64-bit
key, partitioned by hash; the count table of the corpus is their sum by n-gram, joined back to the rows; what
other slices hold of an n-gram returns to its place and is summed per document. A slice is a run of documents of
bounded size whose equal n-grams are combined before they travel, so a word of every document is one row for each
slice. On the way the n-grams of a slice share pages: the page number is the first 16 bits of the key, a page holds
the next 16 and the last 32 bits of its n-grams and their counts, and it becomes rows where it arrives; these three
integers of eight bytes in all are the columns that Spark groups and joins by. A slice has at most 2**16
pages whatever the size of the corpus, so the rows of the exchange grow in proportion to it, and no key is shortened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernel as K
from .shared import Scratch
from .warc import open_fs

ORDER = 3
BACKOFF = 0.4
#: Bytes of text of a slice; a longer text is a slice of its own.
SLICE_BYTES = 16 << 20
#: Words of the corpus for each partition of the count table.
PARTITION_WORDS = 400_000
PAGE_BITS = 16
#: The pages are counted in so many rounds, so that only a part of the n-grams is on disk at a time.
ROUNDS = 2
#: Entries of a page have one byte for the count; an n-gram of more is several entries.
MOST = 127
_U = np.uint64


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the documents and where each begins, made piece by piece so that byte-level arrays stay small."""
    parts, counts = [], []
    for _, _, data, offs in K.slices(text, 1 << 20):
        w = K.Words(data, offs)
        parts.append(w.hash)
        counts.append(w.counts)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=_U), first.astype(np.int64)


def word_count(text: pa.Array) -> int:
    total = 0
    for _, _, data, offs in K.slices(text, 1 << 20):
        inside = ~K.SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offs[:-1][offs[:-1] < len(data)]
        begins[edges] = inside[edges]
        total += int(np.count_nonzero(begins))
    return total


def sorted_order(x: np.ndarray) -> np.ndarray:
    """A stable argsort of hashes: their first bits and the position sort as one integer, the few ties of unequal hashes again."""
    bits = max(1, int(len(x) - 1).bit_length()) if len(x) else 1
    low = _U((1 << bits) - 1)
    joined = x & ~low
    joined |= np.arange(len(x), dtype=_U)
    joined.sort()
    joined &= low
    order = joined.view(np.int64)
    y = x[order]
    for head in np.unique(y[1:][y[1:] < y[:-1]] >> _U(bits)):
        a, b = np.searchsorted(y >> _U(bits), [head, head + _U(1)])
        order[a:b] = order[a:b][np.argsort(y[a:b], kind="stable")]
    return order


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether each element differs from the one before."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return new


def _unsorted(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[order] = x
    return out


class Slice:
    """The n-grams of a slice's documents: sorted distinct ``keys`` with ``counts``.

    With ``places``, also for each order its n-grams' key numbers ``at`` and their documents' ``own`` counts; one order is sorted at a time.
    """

    def __init__(self, text: pa.Array, places: bool = False):
        words = K.Words.__new__(K.Words)
        words.hash, words.first = word_hashes(text)
        self.words = words
        if places:
            self._place()
            return
        every = np.concatenate([words.grams(n)[0] for n in range(1, ORDER + 1)])
        every.sort()
        begin = np.flatnonzero(_changes(every))
        self.keys, self.counts = every[begin], np.diff(np.append(begin, len(every)))

    def _place(self) -> None:
        keys, counts, self.at, self.own = [], [], [], []
        for n in range(1, ORDER + 1):
            grams, first = self.words.grams(n)
            doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
            order = sorted_order(grams)  # n-grams stand in document order, so equal ones come by document
            grams, doc = grams[order], doc[order]
            new = _changes(grams)
            begin = np.flatnonzero(new)
            keys.append(grams[begin])
            counts.append(np.diff(np.append(begin, len(grams))))
            self.at.append(_unsorted(np.cumsum(new, dtype=np.int32) - 1, order))
            size = np.diff(np.append(np.flatnonzero(new | _changes(doc)), len(doc))).astype(np.int32)
            self.own.append(_unsorted(np.repeat(size, size), order))
        del grams, doc, order, new, begin, size
        every = np.concatenate(keys)
        every.sort(kind="stable")  # a merge of sorted runs
        self.keys = every[_changes(every)]
        del every
        self.counts = np.zeros(len(self.keys), dtype=np.int64)
        for i in range(ORDER):
            number = np.searchsorted(self.keys, keys[i]).astype(np.int32)
            self.counts[number] += counts[i]
            self.at[i] = number[self.at[i]]

    def entries(self) -> np.ndarray:
        """The key number of each entry: one for every MOST occurrences, or part of them."""
        return np.repeat(np.arange(len(self.keys), dtype=np.int32), -(-self.counts // MOST))

    def pages(self, number: int, turn: int = 0, rounds: int = 1) -> Iterator[pa.RecordBatch]:
        """(place, page, hi, lo, counts) of the pages of a round: the place joins the slice's ``number`` and the number of the page's first entry."""
        which = self.entries()
        if not len(which):
            return
        every = self.keys[which]
        counts = np.full(len(which), MOST, dtype=np.int8)
        last = np.append(which[1:] != which[:-1], True)
        counts[last] = (self.counts - 1) % MOST + 1
        page = (every >> _U(64 - PAGE_BITS)).astype(np.int32)
        hi, lo = (every >> _U(32)).astype(np.uint16).view(np.int16), every.astype(np.uint32).view(np.int32)
        name = page.astype(np.uint16).view(np.int16)
        first, end = np.searchsorted(page, [(turn << PAGE_BITS) // rounds, ((turn + 1) << PAGE_BITS) // rounds])
        begin = first + np.flatnonzero(np.diff(page[first:end], prepend=-1))
        edge = np.append(begin, end)
        for at in range(0, len(begin), 4096):
            e = edge[at : at + 4097]
            offsets = pa.array((e - e[0]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[e[0] : e[-1]])) for x in (hi, lo, counts)]
            yield pa.RecordBatch.from_arrays([pa.array((number << 32) + e[:-1]), pa.array(name[e[:-1]]), *lists], names=["place", "page", "hi", "lo", "counts"])

    def scores(self, totals: np.ndarray, words: int, leave_out: bool = True) -> np.ndarray:
        """Sum of log10 S over each document's words."""
        counts = self.words.counts
        left = [totals[at] for at in self.at]
        if leave_out:
            for found, own in zip(left, self.own, strict=True):
                found -= own
        n = len(self.words.hash)
        place = np.arange(n) - np.repeat(self.words.first[:-1], counts)
        one = left[0]
        two, three = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        two[place >= 1], three[place >= 2] = left[1], left[2]
        others = np.repeat(words - counts if leave_out else np.full(len(counts), words), counts)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(one > 0, one / others, 1.0 / (others + 1))
            s = np.where(place >= 1, np.where(two > 0, two / np.roll(one, 1), BACKOFF * s), s)
            s = np.where(place >= 2, np.where(three > 0, three / np.roll(two, 1), BACKOFF * s), s)
        out = np.zeros(len(counts))
        full = counts > 0
        if n:
            out[full] = np.add.reduceat(np.log10(s), self.words.first[:-1][full])
        return out


def _read(path: str) -> pa.Table:
    files, name = open_fs(path)
    with files.open_input_stream(name, compression=None) as f:
        return pa.ipc.open_stream(f).read_all()


def _text(t: pa.Table) -> pa.Array:
    column = t.column("text").cast(pa.large_string()).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _slices(folder: str, limit: int):
    """Writes slices of documents to files that no other attempt uses and reports them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_fs(folder)
        held, size, made = [], 0, []

        def finish() -> None:
            nonlocal held, size
            table = pa.Table.from_batches(held)
            words = word_count(_text(table))
            files.create_dir(root, recursive=True)
            name = uuid.uuid4().hex
            with files.open_output_stream(f"{root}/{name}", compression=None) as f, pa.ipc.new_stream(f, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
                w.write_table(table)
            made.append((f"{folder}/{name}", words))
            held, size = [], 0

        for batch in batches:
            for lo, hi, data, _ in K.slices(batch.column(1)):
                if held and size + len(data) > limit:
                    finish()
                held.append(batch.slice(lo, hi - lo))
                size += len(data)
            if held:  # a copy, so that the rest of the batch can go
                held = [pa.Table.from_batches(held).take(pa.array(range(sum(len(x) for x in held)))).combine_chunks().to_batches()[0]]
        if held:
            finish()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["path", "words"])

    return run


def _explode(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(*(c.to_pylist() for c in batch.columns)):
                yield from Slice(_text(_read(path))).pages(number, turn, ROUNDS)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, i, total) that follow each other from one page as one row (slice, at, total); entries are numbered by steps from the one before."""
    for batch in batches:
        place, i, total = (c.to_numpy() for c in batch.columns)
        if len(place):
            begin = np.flatnonzero(np.diff(place, prepend=-1))
            offsets = pa.array(np.append(begin, len(place)).astype(np.int32))
            at = (place & 0xFFFFFFFF) + i
            step = np.diff(at, prepend=0)
            step[begin] = at[begin]
            yield pa.RecordBatch.from_arrays([pa.array(place[begin] >> 32), pa.ListArray.from_arrays(offsets, pa.array(step.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(total))], names=["slice", "at", "total"])


def _numbers(steps: pa.ListArray) -> np.ndarray:
    """The entry numbers of rows made by ``_gather``."""
    flat = steps.flatten().to_numpy().astype(np.int64)
    lens = np.diff(steps.offsets.to_numpy())
    lens = lens[lens > 0]
    begin = np.cumsum(lens) - lens
    sums = np.cumsum(flat)
    return sums - np.repeat(sums[begin] - flat[begin], lens)


def _score(words: int, leave_out: bool):
    """Scores of the slices of a partition, whose rows are sorted by slice: its file, and what other slices hold of its n-grams."""

    def finish(path: str, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        table = _read(path)
        s = Slice(_text(table), places=True)
        totals, which = s.counts, s.entries()
        for at, total in found:
            totals[which[at]] = total
        found.clear()
        del which, s.keys, s.counts
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(s.words.counts.astype(np.int64)), pa.array(s.scores(totals, words, leave_out))], names=["doc_id", "n_words", "log10_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, found = None, None, []
        for batch in batches:
            number = batch.column(0).to_numpy()
            begin = np.flatnonzero(np.diff(number, prepend=-1))
            for lo, hi in zip(begin, np.append(begin[1:], len(number))):
                if number[lo] != now:
                    if now is not None:
                        yield finish(path, found)
                    now, path, found = number[lo], None, []
                part = batch.slice(lo, hi - lo)
                path = next(iter(part.column(3).drop_null().to_pylist()), path)
                found.append((_numbers(part.column(1)).astype(np.int32), part.column(2).flatten().to_numpy()))
        if now is not None:
            yield finish(path, found)

    return run


@contextmanager
def one_exchange(spark: SparkSession):
    """Settings of the counting job: its join on (page, hi, lo) uses the partitioning by page that both sides have instead
    of a second exchange of the n-grams, and the exchange is deleted once the job has written its result."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def held_elsewhere(grams: DataFrame) -> DataFrame:
    """(place, i, total): for each row of ``grams`` (page, hi, lo, place, i, n) whose n-gram other slices hold too, the corpus's count.

    The count table is the sum by n-gram. N-grams of one slice leave it before the join; what is left has one row
    for each n-gram and is the side that is hashed, while the n-grams of the documents stream past it.
    """
    key = ["page", "hi", "lo"]
    table = grams.groupBy(*key).agg(F.sum("n").alias("total"), F.min("place").alias("least"), F.max("place").alias("most")).where("least < most")
    return grams.join(table.select(*key, "total").hint("shuffle_hash"), key).select("place", "i", "total")


def score(spark: SparkSession, docs: DataFrame, leave_out: bool = True) -> DataFrame:
    """doc_id, n_words, log10_score, log10_per_word (both rounded to 6 places) for every row of ``docs`` (doc_id, text).

    Null and blank texts: 0 words, score 0, log10_per_word null. Rows are documents, repeated ones too, each left out of
    its own counts only, or of none if ``leave_out`` is false. Null doc_ids are carried; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    written = scratch.write(rows.mapInArrow(_slices(scratch.path("slices"), SLICE_BYTES), "path string, words long"), "written")
    size = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    each = max(1, min(size.n, 100_000))
    parts = int(min(1 << PAGE_BITS, max(1, size.words // PARTITION_WORDS // ROUNDS)))
    # numbers of at most 31 bits: the scan's partition and the row in it
    files = scratch.write(written.withColumn("id", F.monotonically_increasing_id()), "numbered")
    row = F.col("id") % (1 << 33)
    most = files.agg(F.coalesce(F.max(row), F.lit(0)).alias("m")).first().m
    slices = files.select((F.shiftright("id", 33) * (most + 1) + row).alias("slice"), "path")
    back = None
    for turn in range(ROUNDS):
        pages = slices.repartition(each).mapInArrow(_explode(turn), "place long, page smallint, hi array<smallint>, lo array<int>, counts array<tinyint>")
        dealt = pages.repartition(parts, "page")
        grams = dealt.select("page", "place", "hi", "lo", F.posexplode("counts").alias("i", "n"))
        grams = grams.select("page", F.col("hi")[F.col("i")].alias("hi"), F.col("lo")[F.col("i")].alias("lo"), "place", "i", "n")
        with one_exchange(spark):
            part = scratch.write(held_elsewhere(grams).mapInArrow(_gather, "slice long, at array<int>, total array<long>"), "counts")
        back = part if back is None else back.union(part)
    none = [F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("total")]
    every = back.withColumn("path", F.lit(None).cast("string")).union(slices.select("slice", *none, "path"))
    scored = every.repartition(3 * each, "slice").sortWithinPartitions("slice").mapInArrow(_score(int(size.words), leave_out), "doc_id long, n_words long, log10_score double")
    return scored.select("doc_id", "n_words", F.round("log10_score", 6).alias("log10_score"), F.round(F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")), 6).alias("log10_per_word"))


ORACLE = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
t as (select r, i, w[i] a, case when i > 1 then w[i - 1] end b, case when i > 2 then w[i - 2] end c from d, unnest(range(1, len(w) + 1)) u(i)),
n as (select r, count(*) own, (select count(*) from t) - count(*) others from t group by r),
c1 as (select a, count(*) k from t group by a), o1 as (select r, a, count(*) k from t group by r, a),
c2 as (select b, a, count(*) k from t where b is not null group by b, a), o2 as (select r, b, a, count(*) k from t where b is not null group by r, b, a),
c3 as (select c, b, a, count(*) k from t where c is not null group by c, b, a), o3 as (select r, c, b, a, count(*) k from t where c is not null group by r, c, b, a),
s as (select t.r, i, others, x1.k - y1.k k1, coalesce(p1.k - q1.k, 0) h1, coalesce(x2.k - y2.k, 0) k2, coalesce(p2.k - q2.k, 0) h2, coalesce(x3.k - y3.k, 0) k3
  from t join n on n.r = t.r join c1 x1 on x1.a = t.a join o1 y1 on y1.r = t.r and y1.a = t.a
  left join c1 p1 on p1.a = t.b left join o1 q1 on q1.r = t.r and q1.a = t.b
  left join c2 x2 on x2.b = t.b and x2.a = t.a left join o2 y2 on y2.r = t.r and y2.b = t.b and y2.a = t.a
  left join c2 p2 on p2.b = t.c and p2.a = t.b left join o2 q2 on q2.r = t.r and q2.b = t.c and q2.a = t.b
  left join c3 x3 on x3.c = t.c and x3.b = t.b and x3.a = t.a left join o3 y3 on y3.r = t.r and y3.c = t.c and y3.b = t.b and y3.a = t.a),
v as (select r, case when k1 > 0 then k1::double / others else 1.0::double / (others + 1) end s1, k2, h1, k3, h2, i from s),
z as (select r, log10(case when i > 2 and k3 > 0 then k3::double / h2 when i > 1 and k2 > 0 then (case when i > 2 then 0.4 else 1 end) * (k2::double / h1)
  when i > 2 then 0.16 * s1 when i = 2 then 0.4 * s1 else s1 end) l from v),
g as (select r, sum(l) s from z group by r)
select doc_id, len(w)::bigint n_words, round(coalesce(s, 0), 6) log10_score, round(case when len(w) > 0 then s / len(w) end, 6) log10_per_word from d left join g on g.r = d.r
"""
