"""Packing by optimal length buckets.

A global histogram of lengths is gathered; dynamic programming chooses the bucket boundaries of least total
padding; documents of a bucket are padded to its boundary and grouped into batches of a token budget.
Batches come from exact ranks inside each bucket, built from row numbers in bounded blocks plus block
offsets, so a bucket that holds most documents is still dealt over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import Scratch

BUCKETS = 8
#: Tokens of a batch, padding included; a document longer than this is a batch of its own.
TOKEN_BUDGET = 32_768
BLOCK_ROWS, MOST_BLOCKS = 2_000, 50_000
WORD = r"[^\x20\x09-\x0D]+"


def boundaries(edges: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries out of the sorted lengths ``edges``: at most ``buckets``, the last length among them, of least padding.

    Padding is boundary x count summed over buckets (less the fixed sum of lengths). The best last split of a longer prefix is
    never before that of a shorter one, so each layer is solved by halves in n log n steps. Of equal costs the split with
    smaller boundaries wins. No lengths give no boundary.
    """
    n = len(edges)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    cost = edges * total[1:]  # one bucket up to length i
    back = []
    for _ in range(min(buckets, n) - 1):
        best, came = cost.copy(), np.full(n, -1)
        open_ = [(1, n - 1, 0, n - 2)]
        while open_:
            lo, hi, first, last = open_.pop()
            if lo > hi:
                continue
            i = (lo + hi) // 2
            end = min(last, i - 1) + 1
            way = cost[first:end] + edges[i] * (total[i + 1] - total[first + 1 : end + 1])
            j = first + int(np.argmin(way))
            if way[j - first] < best[i]:
                best[i], came[i] = way[j - first], j
            open_ += [(lo, i - 1, first, j), (i + 1, hi, j, last)]
        back.append(came)
        cost = best
    out, i = [int(edges[-1])], n - 1
    for came in reversed(back):
        if came[i] >= 0:
            i = int(came[i])
            out.append(int(edges[i]))
    return sorted(out)


def pack(spark: SparkSession, docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding for every row of ``docs`` (doc_id, text).

    n_tokens is the number of words and an end token, so null and empty texts take one. Batches of a bucket are
    numbered from 0 and hold budget // bucket_tokens documents (one at least), the last what is left; the order inside a bucket
    is by hash of doc_id, where it is null by the row's place in the table of lengths; repeated rows take a slot each. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(spark, "packing")
    length = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long") + 1
    rows = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", length.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    histogram = rows.groupBy(F.col("n_tokens").alias("edge")).agg(F.count("*").alias("n")).orderBy("edge").collect()  # a row for each length that occurs
    limits = boundaries(np.array([r.edge for r in histogram], dtype=float), np.array([r.n for r in histogram]), buckets)
    total = sum(r.n for r in histogram)
    blocks = min(MOST_BLOCKS, max(1, -(-total // BLOCK_ROWS)))
    bucket, edge = F.lit(max(0, len(limits) - 1)), F.lit(limits[-1] if limits else 1)
    for k in range(len(limits) - 2, -1, -1):
        bucket, edge = F.when(F.col("n_tokens") <= limits[k], F.lit(k)).otherwise(bucket), F.when(F.col("n_tokens") <= limits[k], F.lit(limits[k])).otherwise(edge)
    placed = rows.withColumns({"bucket": bucket.cast("int"), "bucket_tokens": edge.cast("long"), "h": F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id"))})
    # equal spans of the hash, so that blocks follow the order inside the bucket
    placed = placed.withColumn("block", F.floor((F.shiftrightunsigned("h", 33)) * F.lit(blocks) / F.lit(float(1 << 31))).cast("int"))
    counts = placed.groupBy("bucket", "block").agg(F.count("*").alias("m"))
    before = W.partitionBy("bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("bucket", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skip"))
    here = W.partitionBy("bucket", "block").orderBy(F.shiftrightunsigned("h", 33), "h", "doc_id", "row")
    # at most BUCKETS x MOST_BLOCKS rows of 16 bytes
    ranked = placed.withColumn("r", F.row_number().over(here) - 1).join(F.broadcast(offsets), ["bucket", "block"])
    rank = F.col("skip") + F.col("r")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens"))).cast("long")
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(rank / size).cast("long").alias("batch"), F.pmod(rank, size).cast("long").alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding")
    )
