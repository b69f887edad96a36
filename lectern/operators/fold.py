"""Cutting a sequence into chunks that close with the element that brings them to a limit.

Within a span of the sequence everything follows from the length that the open chunk brings in. So each span is first reduced to a table: from
which length on, how many chunks close in it and what is left open at its end. Tables of one sequence are gone through in order, a few rows for each span,
and then every span knows what it begins with and numbers its elements by itself. All steps but that one are over spans of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

CHUNK_CHARS = 2500
#: Elements of a span: places order // SPAN.
SPAN = 1 << 16


def folded(sizes: np.ndarray, limit: int, carry: int = 0) -> tuple[np.ndarray, int, int]:
    """(chunk of each element from 0, chunks that close, length left open), where ``carry`` is open at the start."""
    ends = np.cumsum(sizes)
    closing, at = [], int(np.searchsorted(ends, limit - carry))
    while at < len(ends):
        closing.append(at)
        at = int(np.searchsorted(ends, ends[at] + limit))
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    out[np.array(closing, dtype=np.int64) + 1] = 1
    total = int(ends[-1]) if len(ends) else 0
    return np.cumsum(out)[:-1], len(closing), total - int(ends[closing[-1]]) if closing else carry + total


def table(sizes: np.ndarray, limit: int) -> list[tuple[int, int, int, bool]]:
    """(least length brought in, chunks that close, length left open, whether what was brought in is part of it) of a span, in order."""
    ends = np.cumsum(sizes)
    n, total = len(ends), int(ends[-1]) if len(ends) else 0
    after = np.searchsorted(ends, ends + limit)
    closed, left = np.ones(n, dtype=np.int64), total - ends
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            closed[i] += closed[after[i]]
            left[i] = left[after[i]]
    rows = [(0, 0, total, True)] if total < limit else []
    first = np.searchsorted(ends, 1)  # the earliest element that can close a chunk
    last = min(int(np.searchsorted(ends, limit)), n - 1)
    for i in range(last, int(first) - 1, -1):
        if i == first or ends[i] > ends[i - 1]:
            at = (max(0, limit - int(ends[i])), int(closed[i]), int(left[i]), False)
            if not rows or rows[-1][1:] != at[1:]:
                rows.append(at)
    return rows


def fold_chunks(lengths: Column, limit: int = CHUNK_CHARS) -> Column:
    """Chunk number of every element of an array of lengths, in time linear in its length."""

    def run(column: pa.Array) -> pa.Array:
        found = [None if x is None else folded(np.array(x, dtype=np.int64), limit)[0] for x in column.to_pylist()]
        return pa.array(found, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(lengths)


def _groups(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Bounds of the stretches of ``batch`` that agree in its first ``keys`` columns."""
    change = np.zeros(len(batch), dtype=bool)
    for c in batch.columns[:keys]:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [len(batch)]])


def fold_rows(rows: DataFrame, by: str, order: str, length: str, limit: int = CHUNK_CHARS, span: int = SPAN) -> DataFrame:
    """``rows`` with ``chunk``, numbered from 0 in each ``by`` in the ``order`` of a whole number that no two of its rows share.

    Lengths are whole numbers of 0 or more; null ones are 0. A sequence within one span is numbered at once; only longer ones have tables.
    """
    names = [f"_{i}" for i in range(len(rows.columns))]
    own = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names)], F.col(by).alias("by"), F.col(order).cast("long").alias("at"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("n"))
    own = own.withColumn("span", F.floor(F.col("at") / span).cast("long"))
    kind = rows.schema[by].dataType
    long = own.groupBy(F.col("by").alias("key")).agg(F.min("span").alias("a"), F.max("span").alias("b")).where("a < b").select("key")
    fields = lambda *more: StructType([StructField("key", kind), StructField("span", LongType()), *[StructField(m, LongType()) for m in more]])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the parts of one span

        def done() -> pa.RecordBatch:
            found = table(np.concatenate([h.column(2).to_numpy() for h in held]), limit)
            first = held[0].slice(0, 1)
            return pa.RecordBatch.from_arrays([first.column(i).take(pa.array([0] * len(found))) for i in range(2)] + [pa.array([int(r[k]) for r in found], pa.int64()) for k in range(4)], names=["key", "span", "least", "closed", "left", "open"])

        for batch in batches:
            bounds = _groups(batch, 2)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if held and any(held[0].column(i)[0] != part.column(i)[0] for i in range(2)):
                    yield done()
                    held = []
                held.append(part)
        if held:
            yield done()

    def walked(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        carry, base, out = 0, 0, []
        for at, r in g.sort_values(["span", "least"]).groupby("span", sort=True):
            out.append((key[0], at, carry, base))
            r = r.iloc[int(np.searchsorted(r["least"].to_numpy(), carry, side="right")) - 1]
            carry, base = (carry + int(r["left"]) if r["open"] else int(r["left"])), base + int(r["closed"])
        return pd.DataFrame(out, columns=["key", "span", "carry", "base"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, base = None, 0, 0
        for batch in batches:
            key, bounds = batch.select([0, 1]), _groups(batch, 2)
            n, carries, bases = (batch.column(i).to_numpy() for i in (2, 3, 4))
            out = np.empty(len(batch), dtype=np.int64)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if a == b:
                    continue
                if a or last is None or any(last.column(i)[0] != key.column(i)[0] for i in range(2)):
                    carry, base = int(carries[a]), int(bases[a])
                chunk, closed, carry = folded(n[a:b], limit, carry)
                out[a:b] = chunk + base
                base += closed
            if len(batch):
                last = key.slice(len(batch) - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], pa.array(out)], names=[*names, "chunk"])

    def sorted_spans(df: DataFrame) -> DataFrame:
        return df.repartition("by", "span").sortWithinPartitions("by", "span", "at")

    parts = sorted_spans(own.join(long, F.col("by").eqNullSafe(F.col("key")), "left_semi")).select("by", "span", "n")
    tables = parts.mapInArrow(reduced, fields("least", "closed", "left", "open"))
    starts = tables.groupBy("key").applyInPandas(walked, fields("carry", "base")).withColumnRenamed("span", "of")
    begun = own.join(starts, F.col("by").eqNullSafe(F.col("key")) & (F.col("span") == F.col("of")), "left")
    begun = sorted_spans(begun).select("by", "span", "n", F.coalesce("carry", F.lit(0)).alias("carry"), F.coalesce("base", F.lit(0)).alias("base"), *names)
    out = begun.mapInArrow(finished, StructType([*[StructField(n, f.dataType) for n, f in zip(names, rows.schema)], StructField("chunk", LongType())]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, rows.columns)], "chunk")
