"""Chunks against the sequential model, for arrays and for rows over many spans."""

import random
import time

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.operators import fold


def sequential(sizes, limit, carry=0):
    out, size, chunk = [], carry, 0
    for n in sizes:
        out.append(chunk)
        size += n
        if size >= limit:
            size, chunk = 0, chunk + 1
    return out, size, chunk


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=40), st.integers(1, 60), st.integers(0, 59))
def test_kernel(sizes, limit, carry):
    carry = min(carry, limit - 1)
    want, left, closed = sequential(sizes, limit, carry)
    got = fold.folded(np.array(sizes, dtype=np.int64), limit, carry)
    assert (got[0].tolist(), got[2], got[1]) == (want, left, closed)
    row = [r for r in fold.table(np.array(sizes, dtype=np.int64), limit) if r[0] <= carry][-1] if sizes else (0, 0, 0, True)
    assert (row[1], row[2] + carry * row[3]) == (closed, left)


def test_million_lines_in_linear_time():
    r = np.random.default_rng(1)
    for sizes in (r.integers(0, 120, 1_000_000), np.zeros(1_000_000, dtype=np.int64), np.full(1_000_000, 3000)):
        began = time.process_time()
        got = fold.folded(sizes, 2500)[0]
        assert time.process_time() - began < 20
        assert got.tolist() == sequential(sizes.tolist(), 2500)[0]


def test_rows_over_many_spans(spark):
    r = random.Random(3)
    rows = [(b, 3 * i + (0 if b else 7), r.choice([0, 1, 5, 30, 49, 80, None])) for b in ("x", "y", None) for i in range(r.choice([1, 90, 200]))] + [("z", i, 0) for i in range(40)]
    want = {}
    for b in {x[0] for x in rows}:
        mine = sorted((o, n or 0) for k, o, n in rows if k == b)
        want |= {(b, o): c for (o, _), c in zip(mine, sequential([n for _, n in mine], 50)[0])}
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "book string, place int, n int").withColumns({"carry": F.lit("x"), "base": F.lit("x")})
    for span in (4, 25, 1 << 16):
        out = fold.fold_rows(df, "book", "place", "n", 50, span)
        assert out.columns == [*df.columns, "chunk"]
        assert {(x.book, x.place): x.chunk for x in out.collect()} == want
    assert fold.fold_rows(df.limit(0), "book", "place", "n").count() == 0


def test_arrays(spark):
    df = spark.createDataFrame([([10, 45, 5, 50],), ([],), (None,)], "l array<long>")
    assert [r.c for r in df.select(fold.fold_chunks(F.col("l"), 50).alias("c")).collect()] == [[0, 0, 1, 1], [], None]
