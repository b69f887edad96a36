"""Inverted index in immutable segments, with block-wise top-k, and the query chains over it.

An index is a folder of segments, of removals, and of versions that name the live ones. A segment holds the words of its documents, a line for each
(``docs``), and postings in blocks: the documents of a zone, 2**ZONE_BITS that lie together, that hold a term are one row, with the least length for each count of the
term, from which the best score that the block can give follows exactly. The numbers of a block are packed, about a byte for a place: as arrays, their way through
the exchange, the sort and the files was most of the work of writing. Postings lie in folders by hash of the term, in order of term and of ``top``, the best
weight by the segment's own mean length, so a search opens the folders of its words, reads the heads of their blocks, and then only the pages with blocks that may hold a wanted document.

Writing never changes a segment: new documents are a new one, what they replace and what is deleted is listed in a removal together with the counts of
its terms, so statistics are those of a fresh build. Segments of like size are merged when there are FAN of them.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..sources.files import Conflict, Log, exists, scratch_dir, stamp
from . import grammar as G, search as S

#: Documents of a zone as a power of two, segments of like size that are merged, words that a folder of postings is made for, folders at most.
ZONE_BITS, FAN, BUCKET_WORDS, MOST_BUCKETS = 11, 4, 2_000_000, 4096
#: Words of which the postings are made at a time.
SLICE_WORDS = 400_000
#: Zones that are named in a scan, and ranges of them; beyond, zones are joined.
MOST_NAMED, MOST_RANGES = 20_000, 256
#: Scores within this of each other may change places by rounding.
SLACK = 2e-6
#: Hits that are read for each one shown, before noise and repetitions go: a fixed value.
OVER_FETCH = 8
#: Blocks of a page of postings: a quarter of the documents of a zone, and so many at least. A zone's words are mostly rare, the more of them the larger it is, and each page costs time for each column.
LEAST_PAGE = 64
_BLOCKS = "term string, zone long, n long, best array<struct<tf: int, len: int>>, docs binary, lens binary, tfs binary, places binary"
_POSTINGS = f"{_BLOCKS}, top double"
_DOCS = "zone long, doc_id long, n long, words string"
_REMOVED, _REMOVED_TERMS = "segment string, zone long, doc_id long", "segment string, term string, df long"


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _pages(rows: int) -> dict[str, str]:
    """Options of a writer of pages of so many rows."""
    return {"compression": "zstd", "parquet.page.row.count.limit": str(rows), "parquet.page.size.row.check.min": "8"}


def _any(parts: list[Column]) -> Column:
    """One of ``parts``, as a balanced tree."""
    if not parts:
        return F.lit(False)
    while len(parts) > 1:
        parts = [a | b for a, b in zip(parts[::2], parts[1::2])] + (parts[-1:] if len(parts) % 2 else [])
    return parts[0]


def _saturated(tf: Column | np.ndarray, length: Column | np.ndarray, mean: float) -> Column | np.ndarray:
    """What a count of a term gives in a document of a length, before the term's weight."""
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))


def _top(mean: float) -> Column:
    """The most that a document of a block can have."""
    return F.array_max(F.transform("best", lambda b: _saturated(b["tf"], b["len"], mean)))


def ranges(zones: list[int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all ``zones``, with the widest gaps between them."""
    zones = sorted(zones)
    gaps = sorted(((b - a, i) for i, (a, b) in enumerate(zip(zones, zones[1:])) if b - a > 1), reverse=True)[: most - 1]
    cuts = sorted(i for _, i in gaps)
    return [(zones[a + 1], zones[b]) for a, b in zip([-1, *cuts], [*cuts, len(zones) - 1])] if zones else []


def _blocks(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of (zone, doc_id, words), made where these lie: a zone's documents follow each other, so a word has one block in it, or one more where a file is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.list_value_length(batch.column(2)), 0)).astype(np.int64)
            edge = np.flatnonzero(np.diff(batch.column(0).to_numpy(), prepend=-1))  # first documents of zones
            start = 0
            while start < len(batch):
                end = int(np.searchsorted(np.cumsum(size[start:]), SLICE_WORDS, side="right")) + start
                later = edge[edge > start]
                whole = later[later <= end]
                stop = int(whole[-1]) if len(whole) else int(later[0]) if len(later) else len(batch)  # whole zones
                stop = len(batch) if end >= len(batch) else stop
                found = _block_rows(batch.slice(start, stop - start), buckets)
                if found is not None:
                    yield found
                start = stop

    return run


def _in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``key`` sorted, and the places that its values had; equal ones keep their order."""
    bits = np.int64(len(key)).item().bit_length()
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


def _offsets(first: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.append(first, n).astype(np.int32))


def _block_rows(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch | None:
    zone, ids, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    words = lists.flatten().dictionary_encode()
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    n = len(words)
    if not n:
        return None
    code, doc = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(batch)), size)
    at = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    number = np.cumsum(np.diff(zone, prepend=zone[0]) != 0)
    key, order = _in_order(number[doc] * len(words.dictionary) + code)  # words lie in order of document and place
    doc, at = doc[order], at[order]
    hit = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    block = np.flatnonzero(np.diff(key[hit], prepend=-1))
    tf, held = np.diff(np.append(hit, n)), doc[hit]
    length = size[held]
    owner = np.repeat(np.arange(len(block)), np.diff(np.append(block, len(hit))))
    most = int(tf.max()) + 1
    count, by = _in_order(owner * most + tf)
    each = np.flatnonzero(np.diff(count, prepend=-1))
    least, count = np.minimum.reduceat(length[by], each), count[each]  # the shortest document of each count
    best = pa.ListArray.from_arrays(_offsets(np.searchsorted(count // most, np.arange(len(block))), len(count)), pa.StructArray.from_arrays([pa.array((count % most).astype(np.int32)), pa.array(least.astype(np.int32))], names=["tf", "len"]))
    listed = lambda values: pa.ListArray.from_arrays(_offsets(block, len(hit)), values)
    places = pa.ListArray.from_arrays(_offsets(hit, n), pa.array(at.astype(np.int32)))
    term = words.dictionary.take(pa.array(key[hit[block]] % len(words.dictionary)))
    bucket = np.array([zlib.crc32(t.encode()) % buckets for t in term.to_pylist()], dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket), term.cast(pa.string()), pa.array(zone[held[block]]), pa.array(np.diff(np.append(block, len(hit)))), best, listed(pa.array(ids[held])), listed(pa.array(length.astype(np.int32))), listed(pa.array(tf.astype(np.int32))), listed(places)],
        names=["bucket", "term", "zone", "n", "best", "docs", "lens", "tfs", "places"],
    )


def _deltas(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What each value adds to the one before it in its list; ``first`` is where the lists begin."""
    found = np.diff(values, prepend=values[:1])
    found[first] = values[first]
    return found


def _sums(deltas: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(deltas)
    first = np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - deltas[first], sizes)


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Lists of whole numbers as bytes of seven bits, the lowest first; all bytes of a number but its last have the eighth bit. Signs go to the lowest bit."""
    rest = (values << 1 ^ values >> 63).astype(np.uint64)
    size, high = np.ones(len(rest), dtype=np.int64), rest >> 7
    while high.any():
        size += high > 0
        high >>= 7
    at = np.cumsum(size) - size
    ends = np.append(at, size.sum())[np.append(first, len(values))].astype(np.int32)
    out = np.empty(int(size.sum()), dtype=np.uint8)
    while len(at):
        more = rest > 127
        out[at] = rest & 127 | more.astype(np.uint64) << 7
        at, rest = at[more] + 1, rest[more] >> 7
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _numbers(packed: pa.Array) -> np.ndarray:
    """The numbers of all lists of ``packed``, one after another."""
    ends = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    if ends[0] == ends[-1]:
        return np.empty(0, dtype=np.int64)
    read = np.frombuffer(packed.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    first = np.append(0, np.flatnonzero(read < 128)[:-1] + 1)
    place = np.arange(len(read)) - np.repeat(first, np.diff(np.append(first, len(read))))
    found = np.add.reduceat((read & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)
    return (found >> 1).astype(np.int64) ^ -(found & 1).astype(np.int64)


def _written(buckets: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings with packed numbers and ``top`` by the ``mean`` length, of (zone, doc_id, words) with the words in a line."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pc.if_else(pc.equal(b.column(2), ""), None, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.split_pattern(words, " ")], names=["zone", "doc_id", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(buckets)(lists(batches)):
            docs, places = b.column("docs"), b.column("places").values
            block, hit = np.asarray(docs.offsets)[:-1], np.asarray(places.offsets)[:-1]
            of = lambda x: np.asarray(x).astype(np.int64)
            length, tf = of(b.column("lens").values), of(b.column("tfs").values)
            packed = [_packed(_deltas(of(docs.values), block), block), _packed(length, block), _packed(tf, block), _packed(_deltas(of(places.values), hit), hit[block])]
            top = np.maximum.reduceat(_saturated(tf, length, mean), block)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *packed, pa.array(top)], names=[*b.schema.names, "top"])

    return run


def _read(places: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document of blocks (segment, zone, term, n, docs, lens, tfs, and places if wanted), of some blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.asarray(batch.column("n")) + (np.asarray(pc.binary_length(batch.column("places"))) if places else 0)
            cuts = np.flatnonzero(np.diff(np.cumsum(held) // SLICE_WORDS)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if a < b:
                    yield of_blocks(batch.slice(a, b - a))

    def of_blocks(x: pa.RecordBatch) -> pa.RecordBatch:
        n = np.asarray(x.column("n")).astype(np.int64)
        row = pa.array(np.repeat(np.arange(len(n)), n))
        tf = _numbers(x.column("tfs"))
        made = [pa.array(_sums(_numbers(x.column("docs")), n)), pa.array(_numbers(x.column("lens"))), pa.array(tf.astype(np.int32))]
        if places:
            made.append(pa.ListArray.from_arrays(_offsets(np.cumsum(tf) - tf, int(tf.sum())), pa.array(_sums(_numbers(x.column("places")), tf).astype(np.int32))))
        return pa.RecordBatch.from_arrays([*[x.column(c).take(row) for c in ("segment", "zone", "term")], *made], names=["segment", "zone", "term", "doc_id", "len", "tf"] + ["places"] * places)

    return run


class Index:
    """The index at ``path``, as of its last version or of the ``version`` given."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, path)
        self.state: dict = self.log.read(version) if version else self.log.latest()[1]

    # reading

    @property
    def segments(self) -> dict[str, dict]:
        return self.state.get("segments", {})

    @property
    def removed(self) -> dict[str, dict]:
        """By removal: documents and words that it takes from each segment."""
        return self.state.get("removed", {})

    @property
    def documents(self) -> int:
        return sum(s["docs"] for s in self.segments.values()) - sum(x[0] for r in self.removed.values() for x in r.values())

    @property
    def total(self) -> int:
        """Words of all documents."""
        return sum(s["words"] for s in self.segments.values()) - sum(x[1] for r in self.removed.values() for x in r.values())

    def _table(self, kind: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{name}")

    def _removals(self, table: str, schema: str) -> DataFrame:
        found = [self._table("removed", f"{r}/{table}", schema).where(F.col("segment").isin([*of])) for r, of in self.removed.items()]
        return _union(found) if found else self.spark.createDataFrame([], schema)

    def postings(self, phrases: list[G.Phrase], zones: dict[str, Zones] | None = None) -> DataFrame:
        """(segment, and _POSTINGS) of the words of ``phrases``, of these ``zones`` of segments alone if given."""
        words = sorted({t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)})
        begins = sorted({p.terms[-1] for p in phrases if p.prefix})
        named = [F.col("term").isin(words)] if words else []
        parts = []
        for name, s in self.segments.items():
            if zones is not None and not zones.get(name):
                continue
            at = f"{self.path}/segments/{name}/postings"
            buckets = sorted({zlib.crc32(t.encode()) % s["buckets"] for t in words})
            paths = [at] * bool(s["words"]) if begins else [p for b in buckets if exists(self.spark, p := f"{at}/bucket={b}")]
            if paths:
                rows = self.spark.read.schema(_POSTINGS).parquet(*paths).drop("bucket")
                if zones is None:
                    rows = rows.where(_any(named + [F.col("term").startswith(b) for b in begins]))
                else:  # whole words alone; of each, the pages down to its least block
                    rows = rows.where(_any([(F.col("term") == t) & (F.col("top") >= low) for t, low in zones[name].lows.items()])).where(F.col("zone").isin(zones[name].listed))
                parts.append(rows.withColumn("segment", F.lit(name)))
        return _union(parts) if parts else self.spark.createDataFrame([], _POSTINGS + ", segment string")

    def all_postings(self) -> DataFrame:
        """(term, doc_id, tf, positions) of every live document."""
        parts = [self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/segments/{n}/postings").drop("bucket").withColumn("segment", F.lit(n)) for n, s in self.segments.items() if s["words"]]
        if not parts:
            return self.spark.createDataFrame([], "term string, doc_id long, tf long, positions array<int>")
        return self._hits(_union(parts), True).select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.col("places").alias("positions"))

    def _hits(self, postings: DataFrame, places: bool) -> DataFrame:
        """(segment, term, doc_id, len, tf, places if wanted) of the documents that have not been removed."""
        columns = ["segment", "zone", "term", "n", "docs", "lens", "tfs"] + ["places"] * places
        rows = postings.select(*columns).mapInArrow(_read(places), "segment string, zone long, term string, doc_id long, len long, tf int" + ", places array<int>" * places)
        return rows.join(self._removals("docs", _REMOVED), ["segment", "zone", "doc_id"], "left_anti") if self.removed else rows

    # writing

    def _new_segment(self, rows: DataFrame) -> tuple[str, dict]:
        """A segment of ``rows`` (doc_id, words: a line of them), written; its documents get their zones by the order they lie in."""
        name = uuid.uuid4().hex[:12]
        at = f"{self.path}/segments/{name}"
        rows.select(F.shiftright(F.monotonically_increasing_id(), ZONE_BITS).alias("zone"), "doc_id", "words").withColumn("n", X.words_in("words")).write.options(**_pages(LEAST_PAGE)).parquet(f"{at}/docs")
        docs = self.spark.read.schema(_DOCS).parquet(f"{at}/docs")
        size = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        buckets = min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, size.words) / BUCKET_WORDS))))
        if size.words:
            blocks = docs.where("doc_id is not null").select("zone", "doc_id", "words").mapInArrow(_written(buckets, size.words / size.docs), f"bucket int, {_POSTINGS}")
            blocks = blocks.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "term", F.desc("top"))
            blocks.write.options(**_pages(max(LEAST_PAGE, 1 << ZONE_BITS >> 2))).partitionBy("bucket").parquet(f"{at}/postings")
        return name, {"docs": size.docs, "words": size.words, "buckets": buckets}

    def _live(self, state: dict, columns: list[str]) -> DataFrame:
        """``columns`` of _DOCS and the segment of all documents of ``state`` that are not removed."""
        parts = [self._table("segments", f"{n}/docs", _DOCS).select(F.lit(n).alias("segment"), *columns) for n in state.get("segments", {})]
        if not parts:
            return self.spark.createDataFrame([], _DOCS + ", segment string").select("segment", *columns)
        rows, taken = _union(parts), Index.__new__(Index)
        taken.spark, taken.path, taken.state = self.spark, self.path, state
        return rows.join(taken._removals("docs", _REMOVED), ["segment", "zone", "doc_id"], "left_anti") if state.get("removed") else rows

    def _remove(self, state: dict, ids: DataFrame, but: str | None = None) -> dict:
        """``state`` without the live documents of ``ids`` (doc_id), except those of segment ``but``."""
        state = {**state, "segments": {n: s for n, s in state.get("segments", {}).items()}, "removed": {**state.get("removed", {})}}
        others = {**state, "segments": {n: s for n, s in state["segments"].items() if n != but}}
        if not others["segments"]:
            return state
        name = uuid.uuid4().hex[:12]
        at = f"{self.path}/removed/{name}"
        self._live(others, ["zone", "doc_id"]).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("segment", "zone", "doc_id").write.parquet(f"{at}/docs")
        gone = self.spark.read.schema(_REMOVED).parquet(f"{at}/docs")
        if gone.isEmpty():
            return state
        words = self._live(others, ["zone", "doc_id", "n", "words"]).join(gone, ["segment", "zone", "doc_id"], "left_semi")
        words.where("n > 0").select("segment", F.explode(F.array_distinct(F.split("words", " "))).alias("term")).groupBy("segment", "term").agg(F.count("*").alias("df")).sort("term").write.parquet(f"{at}/terms")
        size = words.groupBy("segment").agg(F.count("*").alias("docs"), F.sum("n").alias("words"))
        state["removed"][name] = {r.segment: [r.docs, r.words] for r in size.collect()}  # a row for each segment
        return state

    def write(self, docs: DataFrame) -> Index:
        """``docs`` (doc_id, text) added, in place of live documents of the same ids. Of rows of one doc_id the text last in order counts.

        Null texts have no terms; documents without a doc_id count in the statistics and are not found.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        twice = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        if not twice.isEmpty():
            one = rows.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
            rows = rows.join(twice, "doc_id", "left_anti").unionByName(one)
        name, segment = self._new_segment(rows.select("doc_id", X.term_line(X.folded(F.col("text"))).alias("words")))
        ids = self._table("segments", f"{name}/docs", _DOCS).where("doc_id is not null").select("doc_id")

        def change(state: dict) -> dict:
            return self._remove({**state, "segments": {**state.get("segments", {}), name: segment}}, ids, name)

        self.state = self.log.update(change)
        return self.merge()

    def delete(self, ids: DataFrame) -> Index:
        """Without the documents of ``ids`` (doc_id); ids that are not there change nothing."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
        self.state = self.log.update(lambda state: self._remove(state, ids))
        return self.merge()

    def _due(self, state: dict) -> list[str]:
        """Segments to merge: FAN of like size, or one that has lost half of its documents."""
        lost = {n: sum(r[n][0] for r in state.get("removed", {}).values() if n in r) for n in state.get("segments", {})}
        tiers: dict[int, list[str]] = {}
        for n, s in sorted(state.get("segments", {}).items()):
            if s["docs"] and 2 * lost[n] >= s["docs"]:
                return [n]
            tiers.setdefault(int(math.log(max(1, s["docs"] - lost[n]), FAN)), []).append(n)
        return next((names for _, names in sorted(tiers.items()) if len(names) >= FAN), [])

    def merge(self) -> Index:
        """Segments due are replaced by one of their live documents, until none is; others are left as they are."""
        while True:
            number, state = self.log.latest()
            due = self._due(state)
            if not due:
                self.state = state
                return self
            live = self._live({**state, "segments": {n: state["segments"][n] for n in due}}, ["zone", "doc_id", "words"])
            name, segment = self._new_segment(live.select("doc_id", "words"))
            segments = {n: s for n, s in state["segments"].items() if n not in due} | ({name: segment} if segment["docs"] else {})
            removed = {r: left for r, of in state.get("removed", {}).items() if (left := {n: x for n, x in of.items() if n not in due})}
            try:
                self.log.commit(number, {**state, "segments": segments, "removed": removed})
            except Conflict:
                continue

    # searching

    def frequencies(self, phrases: list[G.Phrase]) -> dict[G.Phrase, int]:
        """Documents that hold each of ``phrases``, all of one whole word."""
        counted: dict[str, int] = {}
        if phrases:
            for r in self.postings(phrases).groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each word
                counted[r.term] = r.n
            if self.removed:
                for r in self._removals("terms", _REMOVED_TERMS).where(F.col("term").isin([*counted])).groupBy("term").agg(F.sum("df").alias("n")).collect():
                    counted[r.term] -= r.n
        return {p: counted.get(p.terms[0], 0) for p in phrases}

    @property
    def mean(self) -> float:
        """Words of a document."""
        return self.total / max(1, self.documents)

    def _idf(self, n: Column | float) -> Column:
        n = F.lit(float(n)) if not isinstance(n, Column) else n
        return F.greatest(F.log((F.lit(float(self.documents)) - n + 0.5) / (n + 0.5)), F.lit(1e-6))

    def scored(self, tree: G.Node, zones: dict[str, Zones] | None = None, known: dict[G.Phrase, int] | None = None, places: bool = False) -> DataFrame:
        """(doc_id, score) of the documents that match ``tree``, lower is better, and with ``places`` ``hits``, the place of every hit with its phrase's number.

        Documents that hold a phrase are counted here, all of them, unless ``known``; so ``zones`` go with known counts only.
        """
        listed = G.phrases(tree)
        simple = [p for p in listed if len(p.terms) == 1 and not p.prefix]
        known = self.frequencies(simple) if known is None else known
        near = _near(tree)
        need = {p for p in listed if len(p.terms) > 1 or p in near or places}
        rows = self._hits(self.postings(listed, zones), bool(need))
        words = {(t, p.prefix and i == len(p.terms) - 1): None for p in listed for i, t in enumerate(p.terms)}
        of = {w: F.col("term").startswith(w[0]) if w[1] else F.col("term") == w[0] for w in words}
        name = {w: i for i, w in enumerate(words)}
        made = [F.coalesce(F.sum(F.when(c, F.col("tf"))), F.lit(0)).cast("long").alias(f"t{name[w]}") for w, c in of.items()]
        if need:
            made += [F.flatten(F.collect_list(F.when(c, F.col("places")))).alias(f"p{name[w]}") for w, c in of.items()]
        rows = rows.groupBy("segment", "doc_id").agg(F.first("len").alias("len"), *made)
        spots, counts = {}, []
        for i, p in enumerate(listed):
            at = [(t, p.prefix and k == len(p.terms) - 1) for k, t in enumerate(p.terms)]
            if p in need:
                both = F.col(f"p{name[at[0]]}")
                for k, w in enumerate(at[1:], 1):
                    both = F.array_intersect(both, _minus(F.col(f"p{name[w]}"), k))
                spots[p] = both
            counts.append((F.size(spots[p]).cast("long") if len(at) > 1 else F.col(f"t{name[at[0]]}")).alias(f"f{i}"))
        rows = rows.select("doc_id", "len", *counts, *[s.alias(f"s{i}") for i, p in enumerate(listed) if (s := spots.get(p)) is not None])
        count = {p: F.col(f"f{i}") for i, p in enumerate(listed)}
        spots = {p: F.col(f"s{i}") for i, p in enumerate(listed) if p in need}
        unknown = [p for p in listed if p not in known]
        idf = {p: self._idf(known[p]) for p in listed if p in known} | {p: self._idf(F.col(f"d{listed.index(p)}").cast("double")) for p in unknown}
        if unknown:  # one row of counts
            rows = rows.crossJoin(F.broadcast(rows.agg(*[F.count_if(count[p] > 0).alias(f"d{listed.index(p)}") for p in unknown])))
        ok, used = G.matches(tree, count, spots)
        score = F.lit(0.0)
        for p, x in used:
            score = score - idf[p] * _saturated(x, F.col("len"), self.mean)
        shown = [F.array_sort(F.flatten(F.array(*[_numbered(spots[p], i) for i, p in enumerate(listed)]))).alias("hits")] if places and listed else []
        return rows.where(ok).select("doc_id", score.alias("score"), *shown)

    def best(self, tree: G.Node, k: int, passing: Callable[[DataFrame], DataFrame] = lambda hits: hits) -> DataFrame:
        """(doc_id, score) of the ``k`` best matches of ``tree`` that are ``passing``, with those that may share their ranks after rounding; in no order.

        For words alone, the best score of every zone is known from the heads of its blocks. Its most promising zones give a score that ``k``
        documents reach; zones that stay below it are never read. A phrase's score needs all documents that hold it, so a query with phrases reads all.
        """
        listed = G.phrases(tree)
        if any(len(p.terms) > 1 or p.prefix for p in listed) or not listed:
            return passing(self.scored(tree))
        known = self.frequencies(listed)
        of = [F.col("term") == p.terms[0] for p in listed]
        heads = self.postings(listed).select("segment", "zone", "term", "top", _top(self.mean).alias("bound")).groupBy("segment", "zone")
        heads = heads.agg(*[F.max(F.when(c, F.col("bound"))).alias(f"b{i}") for i, c in enumerate(of)], *[F.min(F.when(c, F.col("top"))).alias(f"t{i}") for i, c in enumerate(of)])
        most = F.lit(0.0)
        for i, p in enumerate(listed):
            most = most + self._idf(known[p]) * F.coalesce(F.col(f"b{i}"), F.lit(0.0))
        able = G.possible(tree, {p: F.col(f"b{i}").isNotNull() for i, p in enumerate(listed)})
        lows = [f"t{i}" for i in range(len(listed))]
        zones = heads.where(able).select("segment", "zone", most.alias("most"), *lows)
        by_segment = functools.partial(_by_segment, words={c: p.terms[0] for c, p in zip(lows, listed)})
        tries, tried, worst = k, [], None
        while worst is None:
            tried = zones.orderBy(F.desc("most"), "segment", "zone").limit(tries).collect()
            found = passing(self.scored(tree, by_segment(tried), known)).orderBy("score").limit(k).agg(F.count("*").alias("n"), F.max("score").alias("worst")).first()
            if found.n >= k:
                worst = found.worst
            elif len(tried) < tries or tries > MOST_NAMED:
                break
            tries *= 8
        if worst is None:
            return passing(self.scored(tree, None, known))
        left = zones.where(F.col("most") >= -worst - SLACK).limit(MOST_NAMED + 1).collect()
        return passing(self.scored(tree, by_segment(left) if len(left) <= MOST_NAMED else None, known)).where(F.col("score") <= worst + SLACK)


def _minus(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(k))


def _numbered(places: Column, i: int) -> Column:
    return F.transform(places, lambda x: F.struct(x.alias("at"), F.lit(i).alias("phrase")))


@dataclass
class Zones:
    """Zones of a segment, and for each word the least ``top`` of its blocks in them."""

    listed: list[int] = field(default_factory=list)
    lows: dict[str, float] = field(default_factory=dict)


def _by_segment(rows: list, words: dict[str, str]) -> dict[str, Zones]:
    found: dict[str, Zones] = {}
    for r in rows:
        z = found.setdefault(r.segment, Zones())
        z.listed.append(r.zone)
        for c, w in words.items():
            if r[c] is not None:
                z.lows[w] = min(r[c], z.lows.get(w, math.inf))
    return found


def _near(tree: G.Node) -> set[G.Phrase]:
    return {*(tree.phrases if tree.kind == "near" else ()), *[p for t in tree.parts for p in _near(t)]}


def of_table(spark: SparkSession, docs: DataFrame, path: str) -> Index:
    """The index of ``docs`` (doc_id, text), which is the content of ``path``: written once for each content of it, in the shared folder."""
    root = f"{scratch_dir(spark)}/lectern-index3-{zlib.crc32(stamp(spark, path).encode()):08x}-{len(stamp(spark, path))}"
    found = Index(spark, root)
    return found if found.state else found.write(docs)


# the query chains


def library_tree(query: str) -> tuple[G.Node, G.Node | None]:
    """What a question looks for, and what if nothing is found.

    A query with quotes is read by the search syntax as it is. Else the phrase of its meaningful words or all of them, and then any of them if there are several.
    """
    safe = S.sanitised(query)
    units = [u for w in S.agent_terms(query) if (u := G.terms_of(w))]
    if not units:
        return G.NONE, None
    each = [G.phrase(*u) for u in units]
    if '"' in safe:
        try:
            strict = G.parsed(safe)
        except G.Refused:
            return G.NONE, None
    else:
        strict = G.some(G.phrase(*[t for u in units for t in u]), G.every(*each)) if len(each) > 1 else each[0]
    return strict, G.some(*each) if len(each) > 1 else None


def library(index: Index, docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best ``limit`` passages of ``docs`` (doc_id, title, chapter, content) for a question, with ``score`` and ``rank``.

    Titles and chapters of noise go first; then 8 x ``limit`` hits are taken, and of these, noisy beginnings and repetitions go.
    """
    quiet = S.without_noisy_titles(docs)
    passing = lambda hits: hits.join(quiet.select("doc_id"), "doc_id", "left_semi")
    strict, loose = library_tree(query)
    hits = index.best(strict, OVER_FETCH * limit, passing)
    if loose is not None and hits.isEmpty():
        hits = index.best(loose, OVER_FETCH * limit, passing)
    best = quiet.join(hits, "doc_id").orderBy("score", "doc_id").limit(OVER_FETCH * limit)
    kept = S.first_of_each(S.without_noisy_starts(best), [F.col("score"), F.col("doc_id")])
    return S.numbered(kept, limit, [F.col("score"), F.col("doc_id")])


def concept(index: Index, docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best ``limit`` rows of ``docs`` (doc_id, text, quality) for a query, with ``score``, ``rank`` and ``total``, the rows found.

    The query without fillers is read by the search syntax; one that the syntax refuses, or without hits, is looked for as a substring.
    """
    try:
        tree = G.parsed(" ".join(S.query_terms(query)))
    except G.Refused:
        tree = G.NONE
    order = [F.col("score").asc_nulls_last(), F.desc("quality"), F.col("doc_id")]
    found = index.best(tree, limit)
    if tree == G.NONE or found.isEmpty():
        return S.with_total(S.numbered(S.like(docs, query).withColumn("score", F.lit(None).cast("double")), limit, [F.col("doc_id")]))
    return S.with_total(S.numbered(docs.join(found, "doc_id"), limit, order))


def matching(index: Index, docs: DataFrame, query: str) -> DataFrame:
    """All rows of ``docs`` (doc_id) that match ``query`` by the search syntax, with their score; none for a query that it refuses."""
    try:
        tree = G.parsed(query)
    except G.Refused:
        tree = G.NONE
    return docs.join(index.scored(tree), "doc_id")


_PIECE = r"[^\p{L}\p{N}_]*[\p{L}\p{N}_][\p{L}\p{N}_\p{Mn}]*"


def with_fragments(rows: DataFrame, hits: DataFrame, width: int = 160) -> DataFrame:
    """``rows`` (doc_id, text) with ``snippet``, the best ``width`` words for ``hits`` (doc_id, hits) of a search; rows without hits go.

    The best window has most distinct phrases, then most hits, and begins first; it is moved so that its hits stand in the middle. Hits are marked
    with ** and cuts with ...
    """
    spots = hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", F.col("h.at").alias("at"), F.col("h.phrase").alias("phrase"))
    ahead = S.W.partitionBy("doc_id").orderBy("at").rangeBetween(0, width - 1)
    seen = spots.withColumns({"kinds": F.size(F.collect_set("phrase").over(ahead)), "many": F.count("*").over(ahead), "last": F.max("at").over(ahead)})
    best = seen.groupBy("doc_id").agg(F.max(F.struct("kinds", "many", (-F.col("at")).alias("back"), "last")).alias("b"))
    rows = rows.join(best, "doc_id").join(hits.select("doc_id", F.transform("hits", lambda h: h["at"]).alias("_at")), "doc_id")
    rows = rows.withColumns({"_first": -F.col("b.back"), "_p": F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))}).withColumn("_n", F.size("_p"))
    begin = F.col("_first") - F.floor((F.lit(width) - (F.col("b.last") - F.col("_first"))) / 2)
    rows = rows.withColumn("_begin", F.greatest(F.least(begin, F.col("_n") - width), F.lit(0)).cast("int"))
    marked = F.transform(F.slice("_p", F.col("_begin") + 1, F.lit(width)), lambda w, i: F.when(F.array_contains("_at", F.col("_begin") + i), F.regexp_replace(w, r"([\p{L}\p{N}_][\p{L}\p{N}_\p{Mn}]*)$", "**$1**")).otherwise(w))
    rows = rows.withColumn("_line", F.array_join(marked, ""))
    cut = F.regexp_replace("_line", r"^[^\p{L}\p{N}_*]+", "")
    rest = F.regexp_extract("text", r"[^\p{L}\p{N}_\p{Mn}]*$", 0)
    line = F.concat(F.when(F.col("_begin") > 0, F.concat(F.lit("..."), cut)).otherwise(F.col("_line")), F.when(F.col("_begin") + width < F.col("_n"), F.lit("...")).otherwise(rest))
    return rows.withColumn("snippet", line).drop("b", "_at", "_first", "_p", "_n", "_begin", "_line")
