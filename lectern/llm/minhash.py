"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A text's set is its distinct five-word shingles (64-bit hashes). A sketch of T coordinates is filled in
rounds: in round i < T every shingle is thrown into one hashed bin, and a bin that no earlier round
filled keeps its least value; round T + j throws all shingles into bin j, so every coordinate is filled
after at most 2T rounds. Values of earlier rounds order before later ones, which makes a coordinate
agree with probability equal to the Jaccard similarity while large sets need one or two rounds only.

Bands of R coordinates propose pairs. At similarity 0.75 and the production values (T = 128, R = 4) all
32 bands miss with probability 5e-6. Texts with equal sets are one class, a node of its own whatever the doc_ids of its
rows, so copies are never paired. Each class is first verified against one leader of its buckets. In buckets that then
still hold several components, the members outside the largest component are compared with all others, in blocks of
bounded size that count exact intersections in place and emit a spanning forest of the links found, never the pairs.
A pair is a link only if the full sets satisfy 100 * inter >= 75 * union.

Large groups are split everywhere: classes and minima combine on the map side, rows of heavy buckets, classes and hubs
are joined by broadcast (``shared.spread_join``), and a leader's text is repeated for every FOLLOWERS texts compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernel as K
from .graph import components
from .shared import Scratch, heavy_limit, spread_join

T, R = 128, 4
WORDS = 5
PERCENT = 75
ROUND = K.constants(2 * T, 101)
BAND = K.constants(R, 103)
ROUND_TAG = K.constants(2 * T, 107)
#: Bounds of a chunk; two chunks of a bucket meet in one block. Smaller chunks copy a large bucket's rows to more blocks.
CHUNK_ROWS, CHUNK_SHINGLES = 512, 400_000
#: Texts compared with one leader in a task, if the leader is heavy.
FOLLOWERS = 512
#: Shingles that more texts of a block hold are counted by a matrix product.
LIGHT = 12
_U = np.uint64


def sketches(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sketch matrix (documents, T) of non-empty sets; rows of empty sets stay 0."""
    n = len(first) - 1
    out = np.zeros((n, T), dtype=_U)
    filled = np.zeros((n, T), dtype=bool)
    doc = np.repeat(np.arange(n), np.diff(first))
    elements = sets
    top, rest = _U(64 - T.bit_length() + 1), _U((1 << (64 - T.bit_length() + 1)) - 1)
    worst = _U(0xFFFFFFFFFFFFFFFF)
    for i in range(2 * T):
        if not len(elements):
            break
        begins = np.concatenate([[True], doc[1:] != doc[:-1]])
        alive, local = doc[begins], np.cumsum(begins) - 1
        value = K.mix(elements ^ ROUND[i])
        if i < T:
            slot, value = local * T + (value >> top).astype(np.int64), value & rest
        else:
            slot = local * T + (i - T)
        least = np.full(len(alive) * T, worst, dtype=_U)
        np.minimum.at(least, slot, value)
        least = least.reshape(-1, T)
        mine, done = out[alive], filled[alive]
        new = ~done & (least != worst)
        mine[new] = K.mix(least[new] ^ ROUND_TAG[i])
        out[alive], filled[alive] = mine, done | new
        open_ = ~(done | new).all(axis=1)
        if not open_.all():
            keep = open_[local]
            elements, doc = elements[keep], doc[keep]
    return out


def set_keys(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each set, whatever the order of its members."""
    sums = np.zeros((2, len(first) - 1), dtype=_U)
    for k in range(2):
        sums[k] = np.diff(np.concatenate([np.zeros(1, dtype=_U), np.cumsum(K.mix(sets ^ BAND[k]), dtype=_U)])[first])
    return sums


def digest(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, set sizes, two set keys, band keys) of slices of a text column."""
    for lo, hi, data, offs in K.slices(column):
        sets, first = K.distinct_sets(*K.Words(data, offs).grams(WORDS, whole_if_short=True))
        sizes = np.diff(first)
        sk = sketches(sets, first)
        bands = sk.reshape(len(sizes), T // R, R)
        keys = K.mix((bands * BAND).sum(axis=2, dtype=_U) + ROUND[: T // R])
        yield lo, hi, sizes, set_keys(sets, first), keys


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, own, text = batch.columns
        for lo, hi, sizes, sums, keys in digest(text):
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), own.slice(lo, hi - lo), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), K.lists(keys, T // R)],
                names=["doc_id", "own", "n_shingles", "k1", "k2", "bands"],
            )


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        keep: list[int] = []
        for lo in range(0, len(batch), 256):
            n = min(256, len(batch) - lo)
            pair = []
            for c in (2, 3):
                parts: list[np.ndarray] = []
                for _, _, data, offs in K.slices(batch.column(c).slice(lo, n)):
                    sets, first = K.distinct_sets(*K.Words(data, offs).grams(WORDS, whole_if_short=True))
                    parts += [sets[x:y] for x, y in zip(first[:-1], first[1:])]
                pair.append(parts)
            for i, (x, y) in enumerate(zip(*pair)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(lo + i)
        at = pa.array(keep, type=pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])


def _own_text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, n, k1, k2, text) whose text has that class's set; texts of one doc_id and one hash come together here, but hardly ever do."""
    for batch in batches:
        keep: list[np.ndarray] = []
        n, k1, k2 = (batch.column(c).to_numpy() for c in (1, 2, 3))
        for lo, hi, data, offs in K.slices(batch.column(4)):
            sets, first = K.distinct_sets(*K.Words(data, offs).grams(WORDS, whole_if_short=True))
            sums = set_keys(sets, first).view(np.int64)
            keep.append(lo + np.flatnonzero((np.diff(first) == n[lo:hi]) & (sums[0] == k1[lo:hi]) & (sums[1] == k2[lo:hi])))
        at = pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(4).take(at)], names=["v", "text"])


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a heavy b is dealt over many tasks."""
    sizes = pairs.groupBy("b").agg(F.count("*").alias("m"))
    heavy = sizes.where(F.col("m") >= heavy_limit(pairs.count())).select("b", F.ceil(F.col("m") / FOLLOWERS).cast("int").alias("parts"))
    heavy = F.broadcast(heavy)  # at most MOST_HEAVY rows
    left = texts.select(F.col("v").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("v").alias("b"), F.col("text").alias("text_b"))
    parts = F.coalesce("parts", F.lit(1))
    right = right.join(pairs.select("b").distinct(), "b").join(heavy, "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = pairs.join(heavy, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    return dealt.join(left, "a").join(right, ["b", "part"]).select("a", "b", "text_a", "text_b").mapInArrow(_verify_batches, "a long, b long")


def _links_within(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the similarity graph of these sets, from exact intersection sizes."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets])
    if m <= 6:
        inter = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                if 100 * min(sizes[i], sizes[j]) >= PERCENT * max(sizes[i], sizes[j]):
                    inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        flat, row = np.concatenate(sets), np.repeat(np.arange(m), sizes)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        df = np.diff(np.append(begin, len(flat)))
        inter = np.zeros(m * m)
        for d in range(2, min(LIGHT, m) + 1):  # shingles of few texts: count their pairs
            at = begin[df == d]
            for x in range(d):
                for y in range(x):
                    inter += np.bincount(row[at + x] * m + row[at + y], minlength=m * m) if len(at) else 0
        inter = inter.reshape(m, m)
        inter += inter.T
        heavy = np.flatnonzero(df > LIGHT)  # at most total / LIGHT of them: multiply incidence matrices
        for lo in range(0, len(heavy), 2048):
            part = heavy[lo : lo + 2048]
            col = np.repeat(np.arange(len(part)), df[part])
            at = np.repeat(begin[part] - np.cumsum(df[part]) + df[part], df[part]) + np.arange(df[part].sum())
            x = np.zeros((m, len(part)), dtype=np.float32)
            x[row[at], col] = 1
            inter += x @ x.T
    linked = (inter > 0) & (100 * inter >= PERCENT * (sizes[:, None] + sizes[None, :] - inter))
    np.fill_diagonal(linked, False)
    fresh, found = np.ones(m, dtype=bool), []
    for s in range(m):
        stack = [s] if fresh[s] else []
        fresh[s] = False
        while stack:
            i = stack.pop()
            more = np.flatnonzero(linked[i] & fresh)
            fresh[more] = False
            found += [(i, int(j)) for j in more]
            stack += more.tolist()
    return found


def _within_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block; a partition's rows are sorted by block, and one block at a time is held."""

    def finish(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids = [x[0] for x in held]
        pairs = _links_within([x[1] for x in held])
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], names=["a", "b"])

    block, held = None, []
    for batch in batches:
        key, ids = list(zip(*(batch.column(c).to_pylist() for c in range(3)))), batch.column(3).to_pylist()
        for lo, hi, data, offs in K.slices(batch.column(4)):
            sets, first = K.distinct_sets(*K.Words(data, offs).grams(WORDS, whole_if_short=True))
            for d in range(hi - lo):
                if key[lo + d] != block:
                    if len(held) > 1:
                        yield finish(held)
                    block, held = key[lo + d], []
                held.append((ids[lo + d], sets[first[d] : first[d + 1]]))
    if len(held) > 1:
        yield finish(held)


def _linked_within(scratch: Scratch, labelled: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the members ``labelled`` (key, v, n, c) of every bucket that still holds several components c.

    Buckets of equal membership are compared once. The largest component of a bucket, and the other members, are cut into chunks
    of bounded size. Every chunk of the others meets all chunks in a block, whose exact intersections are counted in place: no
    pair is ever a row, and members of the largest component do not meet each other.
    """
    h1, h2 = F.xxhash64("v"), F.xxhash64("v", F.lit(1))
    by_component = labelled.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.bit_xor(h1).alias("x1"), F.bit_xor(h2).alias("x2"))
    biggest = F.max_by("c", F.struct("m", "c"))
    keys = by_component.groupBy("key").agg(biggest.alias("g"), F.count("*").alias("parts"), F.sum("m").alias("m"), F.max(F.struct("m", "c", "n")).alias("most"), F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")).where("parts > 1")
    chunks = lambda m, n: F.greatest(F.ceil(m / CHUNK_ROWS), F.ceil(n / CHUNK_SHINGLES), F.lit(1)).cast("int")
    keys = keys.select("key", "g", "m", "x1", "x2", chunks(F.col("most.m"), F.col("most.n")).alias("inner"), chunks(F.col("m") - F.col("most.m"), F.col("n") - F.col("most.n")).alias("outer"))
    keys = scratch.write(keys.groupBy("m", "x1", "x2").agg(F.min(F.struct("key", "g", "inner", "outer")).alias("k")).select("m", "k.*"), "mixed")
    rest = spread_join(labelled.select("key", "v", "c"), keys, ["key"])
    inside = F.col("c") == F.col("g")
    # blocks (i, j): i a chunk of the others; j one of theirs, not before it, or, from ``outer`` on, one of the largest component
    mine = F.pmod(F.xxhash64("v", F.lit(5)), F.when(inside, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    placed = rest.select("key", "v", inside.alias("inside"), "inner", "outer", F.when(inside, mine + F.col("outer")).otherwise(mine).alias("mine"))
    ends = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("inner") + F.col("outer"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), ends - 1)))
    # members of one chunk meet in each of its blocks; a chunk of the largest component is always among them
    blocks = placed.where("mine <> o").select("key", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "v")
    full = blocks.join(texts, "v").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return full.select("key", "i", "j", "v", "text").mapInArrow(_within_batches, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null or blank text: n_shingles 0, linked with nothing, kept. Fewer than five words: the whole sequence is the
    one shingle. Repeated rows: each row is returned, kept if its doc_id is its component's smallest; rows that share a doc_id but
    not a text are compared each by its own text. Null doc_id: the row is its own component (null, kept). Ties: the smallest
    doc_id names the component. Empty table: no rows.
    """
    scratch = Scratch(spark, "minhash")
    text = F.col("text").cast("string")
    # ``own`` tells texts of one doc_id apart
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), text.alias("text"))
    rows = scratch.write(docs.mapInArrow(_sketch_batches, "doc_id long, own long, n_shingles long, k1 long, k2 long, bands array<long>"), "sketch")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    same = ["k1", "k2", "n_shingles"]
    classes = real.groupBy(*same).agg(F.min(F.struct("doc_id", "own")).alias("text_of"), F.count("*").alias("m"), F.first("bands").alias("bands"))
    classes = scratch.write(classes.select(*same, "text_of", F.col("text_of.doc_id").alias("rep"), "m", "bands").withColumn("v", F.monotonically_increasing_id()), "classes")
    exploded = classes.select("v", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = scratch.write(exploded.groupBy("key").agg(F.min("v").alias("leader"), F.count("*").alias("m")).where("m > 1"), "buckets")
    members = scratch.write(spread_join(exploded, buckets, ["key"]), "members")
    stars = scratch.write(members.where("v <> leader").groupBy(F.col("v").alias("a")).agg(F.min("leader").alias("b")), "stars")
    involved = classes.join(members.select("v").distinct(), "v", "left_semi").select("v", F.col("n_shingles").alias("n"), "k1", "k2", "text_of.*")
    found = docs.join(involved, ["doc_id", "own"]).select("v", "n", "k1", "k2", "text").mapInArrow(_own_text_batches, "v long, text string")
    texts = scratch.write(found.dropDuplicates(["v"]), "texts")
    links = scratch.write(_verified(texts, stars), "links")
    first = components(scratch, links)
    labelled = members.join(first.select(F.col("id").alias("v"), "component"), "v", "left").select("key", "v", "n", F.coalesce("component", "v").alias("c"))
    more = scratch.write(_linked_within(scratch, scratch.write(labelled, "labelled"), texts), "links")
    roots = components(scratch, links.union(more)).select(F.col("id").alias("v"), F.col("component").alias("root"))
    named = scratch.write(classes.select(*same, "v", "rep", "m").join(roots, "v", "left").select(*same, "rep", "m", F.coalesce("root", "v").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("m"))
    # a row of a class without copies and links is its own component; all others get the component of their class
    known = spread_join(named.withColumnRenamed("m", "copies"), smallest, ["root"]).where("copies > 1 or rep <> component_id")
    known = scratch.write(known.select(*same, "component_id", F.col("copies").alias("m")), "known")
    digits = rows.select("doc_id", *same)
    out = spread_join(digits.where("n_shingles > 0"), known, same, "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(digits.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
