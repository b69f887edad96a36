"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in two halves; an independent codebook for each half (k-means on a bounded sample) spans
a product grid of cells, and every vector is filed in the cell of its two nearest codes. A query visits cells
in the order of its summed half distances (multi-sequence traversal). How many it visits is set so that on
the sample, and on points placed at the very threshold from it, the partner's cell is among them for the
target share. All members of visited cells are verified by cosine in double precision.

Equal vectors are one class with a weight. A heavy cell is cut into chunks, members and queries alike, that meet in
blocks; a block is compared tile by tile, and tiles emit link counts and a spanning forest of links, never the pairs.
The codebooks grow with the square root of the number of vectors, so a cell keeps its size; so does their sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .graph import components
from .shared import Scratch, heavy_limit, spread_join

COSINE = 0.95
#: Bounds of the sample that codebooks and the number of visits are fitted on; within them it has SAMPLE_PER_CODE rows a code.
SAMPLE, MOST_SAMPLE, SAMPLE_PER_CODE = 8192, 65_536, 16
#: Vectors of a cell on average, up to MOST_CODES codes a half (a billion vectors).
ROWS_PER_CELL, MOST_CODES = 64, 4096
TARGET = 0.99
#: Partners of one query that count for the number of visits, so that no large group decides it.
PARTNERS = 20
MEMBERS, QUERIES = 1024, 2048
#: Candidate cells that are ordered at once.
CANDIDATES = 4_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codes of the rows of x: k distinct sample rows at first, empty codes stay."""
    rng = np.random.default_rng(17)
    c = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        near = np.concatenate([(-2 * x[lo : lo + 4096] @ c.T + (c * c).sum(axis=1)).argmin(axis=1) for lo in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        used, begin = np.unique(near[order], return_index=True)
        if x.shape[1]:
            c[used] = np.add.reduceat(x[order], begin, axis=0) / np.diff(np.append(begin, len(x)))[:, None]
    return c


def distances(x: np.ndarray, codes: list[np.ndarray]) -> list[np.ndarray]:
    """Squared distances of each row's halves to the codes of that half."""
    half = codes[0].shape[1]
    return [(p * p).sum(axis=1)[:, None] - 2 * p @ c.T + (c * c).sum(axis=1) for p, c in zip((x[:, :half], x[:, half:]), codes)]


def traversal(d1: np.ndarray, d2: np.ndarray, visits: int) -> np.ndarray:
    """The first ``visits`` cells (row-major numbers) of each row in the order of multi-sequence traversal.

    The cell at ranks (i, j) comes after the (i + 1)(j + 1) - 1 that are no farther in both halves, so only ranks with
    (i + 1)(j + 1) <= visits can be among the first; these are ordered by summed distance, for some rows at a time.
    """
    k1, k2 = d1.shape[1], d2.shape[1]
    visits = min(visits, k1 * k2)
    step = max(1, CANDIDATES // max(1, int(visits * (1 + np.log(visits)))))
    if len(d1) > step:
        return np.concatenate([traversal(d1[lo : lo + step], d2[lo : lo + step], visits) for lo in range(0, len(d1), step)])
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    ij = np.array([(i, j) for i in range(min(k1, visits)) for j in range(min(k2, visits // (i + 1)))])
    row = np.arange(len(d1))[:, None]
    a, b = o1[:, ij[:, 0]], o2[:, ij[:, 1]]
    total = d1[row, a] + d2[row, b]
    first = np.argsort(total, axis=1, kind="stable")[:, :visits]
    return (a * k2 + b)[row, first]


def visits_needed(x: np.ndarray, codes: list[np.ndarray], target: float = TARGET) -> int:
    """Cells to visit so that ``target`` of the partners are found: linked pairs of the sample, and random points at the threshold."""
    rng = np.random.default_rng(19)
    q = x[np.sort(rng.permutation(len(x))[:1000])]
    noise = rng.standard_normal(q.shape)
    noise -= (noise * q).sum(axis=1, keepdims=True) * q
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    partners = [(q, COSINE * q + np.sqrt(1 - COSINE**2) * noise)]
    i, j = np.nonzero(q @ x.T >= COSINE)
    far = (q[i] * x[j]).sum(axis=1) < 1 - 1e-9
    i, j = i[far], j[far]
    few = np.arange(len(i)) - np.searchsorted(i, i) < PARTNERS
    i, j = i[few], j[few]
    if len(i):
        partners.append((q[i], x[j]))
    need = 1
    for a, b in partners:
        (p1, p2), (r1, r2) = distances(a, codes), distances(b, codes)
        home = (r1.argmin(axis=1), r2.argmin(axis=1))
        row = np.arange(len(a))
        mine = p1[row, home[0]] + p2[row, home[1]]
        rank = np.array([np.searchsorted(np.sort(u), m - 1e-12 - v, side="left").sum() + 1 for u, v, m in zip(p1, p2, mine)])
        need = max(need, int(np.quantile(rank, target, method="higher")))
    return need


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double; the scaling by the largest component keeps tiny and huge vectors apart from 0 and infinity."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """The matrix of a list column whose lists all have ``dims`` members."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a bipartite graph given as a matrix (queries, members)."""
    q_new, m_new = linked.any(axis=1), np.ones(linked.shape[1], dtype=bool)
    for s in np.flatnonzero(q_new):
        stack = [s] if q_new[s] else []
        q_new[s] = False
        while stack:
            q = stack.pop()
            more = np.flatnonzero(linked[q] & m_new)
            m_new[more] = False
            for m in more:
                yield int(q), int(m)
                again = np.flatnonzero(linked[:, m] & q_new)
                q_new[again] = False
                for r in again:
                    yield int(r), int(m)
                    stack.append(int(r))


def _tile(q: dict, m: dict, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """(a, b, n) of the links between queries and members: counts where b is None, a spanning forest with n 0."""
    linked = q["v"] @ m["v"].T >= cosine
    linked &= q["id"][:, None] != m["id"][None, :]
    if not linked.any():
        return
    # a member that visits the query's cell counts the link itself, as a query there
    unseen = linked.copy()
    some = np.flatnonzero(linked.any(axis=0))
    unseen[:, some] &= ~np.stack([np.isin(q["home"], m["probes"][k]) for k in some], axis=1)
    for ids, counts in ((q["id"], linked @ m["m"]), (m["id"], q["m"] @ unseen)):
        k = np.flatnonzero(counts)
        yield ids[k], None, counts[k]
    x, y = np.array(list(_forest(linked))).T
    yield q["id"][x], m["id"][y], np.zeros(len(x), dtype=np.int64)


def _blocks(dims: int, cosine: float):
    """Links of each block (cell, i, j); a partition's rows are sorted by block, and one block at a time is held."""

    def finish(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        query, ids, m, home = (np.concatenate([h[k] for h in held]) for k in range(4))
        probes, v = [x for h in held for x in h[4]], _unit(np.concatenate([h[5] for h in held]))

        def sides(rows: np.ndarray, most: int) -> list[dict]:
            cut = [rows[lo : lo + most] for lo in range(0, len(rows), most)]
            return [{"id": ids[k], "m": m[k], "home": home[k], "probes": [probes[x] for x in k], "v": v[k]} for k in cut]

        asked = sides(np.flatnonzero(query), QUERIES)
        for of in sides(np.flatnonzero(~query), MEMBERS):
            for by in asked:
                for a, b, n in _tile(by, of, cosine):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            block = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            begin = np.flatnonzero(np.append(True, (block[1:] != block[:-1]).any(axis=1)))
            for lo, hi in zip(begin, np.append(begin[1:], len(block))):
                part = batch.slice(lo, hi - lo)
                if tuple(block[lo]) != now:
                    if held:
                        yield from finish(held)
                    now, held = tuple(block[lo]), []
                probes = part.column(7)
                edge = probes.offsets.to_numpy()
                flat = probes.flatten().to_numpy()
                lists = [flat[x - edge[0] : y - edge[0]] for x, y in zip(edge[:-1], edge[1:])]
                held.append((part.column(3).to_numpy(zero_copy_only=False), *(part.column(c).to_numpy() for c in (4, 5, 6)), lists, _rows(part.column(8), dims)))
        if held:
            yield from finish(held)

    return run


def _one_dimension(spark: SparkSession, scratch: Scratch, reps: DataFrame, dims: int, cosine: float) -> DataFrame:
    """Rows (a, b, n) from the classes ``reps`` (id, m, e): link counts where b is null, else links."""
    kind = reps.schema["e"].dataType.simpleString()
    total = reps.count()
    codes_wanted = int(np.clip(np.sqrt(total / ROWS_PER_CELL), 1, MOST_CODES))
    sample = int(np.clip(SAMPLE_PER_CODE * codes_wanted, SAMPLE, MOST_SAMPLE))
    x = _unit(np.array([r.e for r in reps.orderBy(F.xxhash64("id"), "id").select("e").limit(sample).collect()]))
    half = max(1, dims // 2)
    k = min(codes_wanted, len(x))
    codes = [kmeans(x[:, :half], k), kmeans(x[:, half:], k) if dims > 1 else np.zeros((1, 0))]
    visits = visits_needed(x, codes)
    shared = spark.sparkContext.broadcast(codes)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                cells = traversal(*distances(_unit(_rows(part.column(2), dims)), shared.value), visits).astype(np.int32)
                probes = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells[:, 0]), probes, part.column(2)], names=["id", "m", "home", "probes", "e"])

    index = scratch.write(reps.select("id", "m", "e").mapInArrow(file, f"id long, m long, home int, probes array<int>, e {kind}"), "index")
    members = index.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n"))
    asked = index.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
    # cells that are cut: heavy ones, so at most MOST_HEAVY
    sizes = scratch.write(members.join(asked, "cell"), "cells")
    rows = sizes.agg(F.coalesce(F.sum(F.col("n") + F.col("q")), F.lit(0)).alias("n")).first().n
    cuts = sizes.where(F.col("n") + F.col("q") >= heavy_limit(rows)).select("cell", F.ceil(F.col("n") / MEMBERS).cast("int").alias("mi"), F.ceil(F.col("q") / QUERIES).cast("int").alias("qj"))
    mi, qj = F.coalesce("mi", F.lit(1)), F.coalesce("qj", F.lit(1))
    row = ["id", "m", "home"]
    left = index.withColumn("cell", F.col("home")).join(F.broadcast(cuts), "cell", "left")
    left = left.select("cell", F.pmod(F.xxhash64("id"), mi).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), qj - 1)).alias("j"), F.lit(False).alias("query"), *row, "probes", "e")
    # a query travels without its probes
    right = index.select("*", F.explode("probes").alias("cell")).join(F.broadcast(cuts), "cell", "left")
    right = right.select("cell", F.explode(F.sequence(F.lit(0), mi - 1)).alias("i"), F.pmod(F.xxhash64("id", F.lit(3)), qj).cast("int").alias("j"), F.lit(True).alias("query"), *row, F.array().cast("array<int>").alias("probes"), "e")
    blocks = left.union(right).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return blocks.mapInArrow(_blocks(dims, cosine), "a long, b long, n long")


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows without
    vec_id (component null, kept) or vectors of different lengths with each other. Repeated rows are vectors of their own
    that link to each other; rows that share a vec_id but not a vector are compared each by its own. Ties: the smallest vec_id
    names the component. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(spark, "embeddings")
    e = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    e = e if kind in ("float", "double") else e.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    number = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    good = F.coalesce(number & F.exists("e", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    keyed = rows.select("vec_id", "e", F.when(good, F.xxhash64("e")).alias("k1"), F.when(good, F.xxhash64(F.lit(1), "e")).alias("k2"))
    classes = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.any_value("e").alias("e"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = None
    for r in classes.select(F.size("e").alias("d")).distinct().orderBy("d").collect():
        part = scratch.write(_one_dimension(spark, scratch, classes.where(F.size("e") == r.d), r.d, cosine), "links")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(scratch, found.where("b is not null").select("a", "b"))
    known = classes.select("k1", "k2", "id", "rep", "m").join(counts, "id", "left").join(roots, "id", "left").where("m > 1 or n is not null or component is not null")
    known = scratch.write(known.select("k1", "k2", "rep", F.col("m").alias("copies"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("root")), "known")
    smallest = known.groupBy("root").agg(F.min("rep").alias("c"), F.count("*").alias("m"))
    known = scratch.write(spread_join(known, smallest, ["root"]).select("k1", "k2", "n", "c", F.col("copies").alias("m")), "named")
    out = spread_join(keyed.where("k1 is not null").select("vec_id", "k1", "k2"), known, ["k1", "k2"], "left").select("vec_id", "n", "c")
    out = out.unionByName(keyed.where("k1 is null").select("vec_id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("c")))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
