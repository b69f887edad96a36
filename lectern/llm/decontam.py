"""Benchmark decontamination by spaced seeds.

Text is lower-cased and read as tokens: runs of letters, marks and digits of any script, Chinese and Japanese characters one by one. Each fixed mask hashes six positions of a
window and ignores the others, so a substitution at an ignored position leaves the hash unchanged. Hashes of
all windows of the training documents are joined to those of the benchmark; around every hit the document
and the item are aligned and the run of most agreeing tokens is measured, among those with enough agreement,
substitutions included. An item of under six tokens, which no mask fits, is found where it occurs whole.

The seed table of a benchmark of up to BLOCK_BYTES is shipped to the tasks (a broadcast hash join). A larger one is
joined by shuffle: a document's distinct seed hashes that pass a bit filter of the benchmark's become rows, are joined to
the table of the benchmark's seeds and combined to a list of candidate items for each document; documents that have
one are read again and verified against the texts of these items. So the documents are read twice whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import kernel as K
from .shared import Scratch, spread_join

#: Masks over token positions: a contiguous one, and ones that pass every 6th, 5th and 4th token substituted.
MASKS = ("111111", "11011011", "111001011", "1100110011")
SEED_TOKENS = 6
#: A run counts with so many agreeing tokens (or, for a shorter item, this share of it) and this share of agreement.
MIN_MATCHES, MIN_COVER, MIN_IDENTITY = 10, 0.8, 0.75
IDENTITY_IS, IDENTITY_OF = MIN_IDENTITY.as_integer_ratio()
#: Bytes of benchmark text whose seeds are broadcast; a larger benchmark is joined by shuffle.
BLOCK_BYTES = 8 << 20
#: Bits of the filter of a broadcast table, and of the one that spares documents' seeds the shuffle (a byte each).
FILTER_BITS, SHUFFLE_BITS = 22, 26
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = False
SEPARATOR[128:] = False  # what ``spelled`` leaves of them are letters, marks and digits
_U = np.uint64


def spelled(text: Column) -> Column:
    """Lower-cased text with a blank for each non-ASCII character that is no letter, mark or digit, and blanks around Chinese and Japanese ones."""
    text = F.lower(text.cast("string"))
    plain = F.regexp_replace(text, r"[^\x00-\x7F\p{L}\p{M}\p{N}]", " ")
    apart = F.regexp_replace(plain, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])", " $1 ")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(apart)


def seeds(words: K.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the window starts and their hashes; windows stay inside their text."""
    total = len(words.hash)
    left = np.repeat(words.first[1:], words.counts) - np.arange(total)
    for k, mask in enumerate(MASKS):
        if total < len(mask):
            continue
        acc = np.zeros(total - len(mask) + 1, dtype=_U)
        for j, p in enumerate(i for i, c in enumerate(mask) if c == "1"):
            acc += words.hash[p : p + len(acc)] * K.STEP[j]
        at = np.flatnonzero(left[: len(acc)] >= len(mask))
        yield at, K.mix(acc[at] + K.LENGTH_SALT[k + 1 : k + 2])


def sequences(words: K.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all runs of n tokens inside a text, and their hashes."""
    total = len(words.hash)
    left = np.repeat(words.first[1:], words.counts) - np.arange(total)
    at = np.flatnonzero(left >= n)
    acc = np.zeros(len(at), dtype=_U)
    for j in range(n):
        acc += words.hash[at + j] * K.STEP[j]
    return at, K.mix(acc)


class Seeds:
    """Sorted seed hashes of a block of items with their (item, position), and the items' token hashes."""

    def __init__(self, items: list[tuple[int, str]]):
        text = pa.array([t or "" for _, t in items], pa.large_string())
        self.ids = [i for i, _ in items]
        data, offs = K.buffers(text)
        words = K.Words(data[offs[0] : offs[-1]], offs - offs[0], SEPARATOR)
        self.tokens, self.first = words.hash, words.first
        found = list(seeds(words))
        at = np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=np.int64)
        h = np.concatenate([x for _, x in found]) if found else np.zeros(0, dtype=_U)
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], at[order]
        self.item = np.searchsorted(self.first, self.at, side="right") - 1
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.hash >> _U(64 - FILTER_BITS)] = True
        self.short = {}  # items of under SEED_TOKENS tokens by their number: sorted hashes of the whole and the items
        for n in range(1, SEED_TOKENS):
            item = np.flatnonzero(words.counts == n)
            if len(item):
                at, h = sequences(words, n)
                h = h[np.searchsorted(at, self.first[item])]
                order = np.argsort(h, kind="stable")
                self.short[n] = h[order], item[order]


def best_run(same: np.ndarray) -> tuple[int, int]:
    """(start, end) of the run of most matches among those with a share of MIN_IDENTITY; it begins and ends with a match; the first of equals."""
    hits = np.concatenate([[0], np.cumsum(same)])
    # matches >= MIN_IDENTITY x length, in integers: the sum does not fall from the run's start to its end
    c = IDENTITY_OF * hits - IDENTITY_IS * np.arange(len(hits))
    start = np.searchsorted(-np.minimum.accumulate(c), -c)  # of each end, the first start that reaches it
    matches = hits - hits[start]
    if not matches.any():
        return 0, 0
    end = int(np.argmax(matches))
    start = int(start[end])
    return start + int(np.argmax(same[start:end])), end


def overlaps(table: Seeds, words: K.Words) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item, matches, run length, document token, item token): the best run of each pair that counts."""
    hits = set()
    for size, (whole, items) in table.short.items():
        at, h = sequences(words, size)
        lo, hi = np.searchsorted(whole, h, "left"), np.searchsorted(whole, h, "right")
        n = hi - lo
        entry = items[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        where = np.repeat(at, n)
        doc = np.searchsorted(words.first, where, side="right") - 1
        _, once = np.unique(doc * len(table.ids) + entry, return_index=True)  # the first place in each document
        hits.update(zip(doc[once].tolist(), entry[once].tolist(), (where - table.first[entry])[once].tolist()))
    for at, h in seeds(words):
        maybe = np.flatnonzero(table.filter[h >> _U(64 - FILTER_BITS)])
        lo, hi = np.searchsorted(table.hash, h[maybe], "left"), np.searchsorted(table.hash, h[maybe], "right")
        n = hi - lo
        if not n.sum():
            continue
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        where = np.repeat(at[maybe], n)
        doc = np.searchsorted(words.first, where, side="right") - 1
        shift = where - table.at[entry]
        hits.update(zip(doc.tolist(), table.item[entry].tolist(), shift.tolist()))
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for doc, item, shift in sorted(hits):
        a, b = table.first[item], table.first[item + 1]
        lo, hi = max(a, words.first[doc] - shift), min(b, words.first[doc + 1] - shift)
        same = table.tokens[lo:hi] == words.hash[lo + shift : hi + shift]
        s, e = best_run(same)
        matches = int(same[s:e].sum())
        need = min(MIN_MATCHES, b - a, max(SEED_TOKENS, int(np.ceil(MIN_COVER * (b - a)))))
        if matches >= need and matches >= MIN_IDENTITY * (e - s):
            run = (matches, e - s, int(lo + s + shift - words.first[doc]), int(lo + s - a))
            if matches > best.get((doc, item), (0,))[0]:
                best[doc, item] = run
    for (doc, item), run in best.items():
        yield doc, item, *run


def seed_keys(words: K.Words, short: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of all seeds, and of all runs of one to five tokens, as which items of that size count whole."""
    for at, h in seeds(words):
        yield np.searchsorted(words.first, at, side="right") - 1, h
    for n in range(1, SEED_TOKENS):
        if short:
            at, h = sequences(words, n)
            yield np.searchsorted(words.first, at, side="right") - 1, h
        else:
            item = np.flatnonzero(words.counts == n)
            if len(item):
                at, h = sequences(words, n)
                yield item, h[np.searchsorted(at, words.first[item])]


def _keys(kept: bytes | None):
    """Distinct (row, h) of rows (row, text): a document's that pass the bit filter, or an item's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = None if kept is None else np.frombuffer(kept.value, dtype=bool)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, offs in K.slices(batch.column(1)):
                parts = []
                for doc, h in seed_keys(K.Words(data, offs, SEPARATOR), kept is not None):
                    some = slice(None) if passes is None else passes[h >> _U(64 - SHUFFLE_BITS)]
                    parts.append(np.column_stack([doc[some].astype(_U), h[some]]))
                if parts:
                    found = np.unique(np.concatenate(parts), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + found[:, 0].astype(np.int64)]), pa.array(found[:, 1].view(np.int64))], names=["row", "h"])

    return run


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, item, matches, ...) of rows (row, text, item, item text)."""
    names = ["row", "item", "matches", "run_tokens", "doc_token", "item_token"]
    for batch in batches:
        out = []
        for row, text, item, wanted in zip(*(batch.column(c).to_pylist() for c in range(4))):
            data, offs = K.buffers(pa.array([text], pa.large_string()))
            for _, _, *rest in overlaps(Seeds([(item, wanted)]), K.Words(data, offs, SEPARATOR)):
                out.append((row, item, *rest))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)


def _by_shuffle(scratch: Scratch, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contaminated`` for rows (row, text) of documents and items, as (row, item, ...)."""
    spark = scratch.spark
    table = scratch.write(items.mapInArrow(_keys(None), "row long, h long"), "seeds").withColumnRenamed("row", "item")
    slots = table.select(F.shiftrightunsigned("h", 64 - SHUFFLE_BITS).alias("slot")).distinct()
    # the filter's set bytes, gathered in pieces of a bounded number
    passes = np.zeros(1 << SHUFFLE_BITS, dtype=bool)
    for r in slots.groupBy(F.floor(F.col("slot") / 4096).alias("p")).agg(F.collect_list("slot").alias("slots")).toLocalIterator():
        passes[r.slots] = True
    kept = spark.sparkContext.broadcast(passes.tobytes())
    seen = scratch.write(docs.mapInArrow(_keys(kept), "row long, h long"), "hashes")
    # the items of a seed are as many as the benchmark holds it; a seed of many documents is joined where these lie
    shared = scratch.write(table.groupBy("h").agg(F.collect_list("item").alias("items")).join(seen.groupBy("h").agg(F.count("*").alias("m")), "h"), "shared")
    pairs = scratch.write(spread_join(seen, shared, ["h"]).select("row", F.explode("items").alias("item")).distinct(), "candidates")
    texts = docs.join(pairs, "row").join(items.select(F.col("row").alias("item"), F.col("text").alias("wanted")), "item")
    return texts.select("row", "text", "item", "wanted").mapInArrow(_verify_rows, "row long, item long, matches long, run_tokens long, doc_token long, item_token long")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """doc_id, item_id, matches, run_tokens, doc_token, item_token: one row for each row of ``docs`` and item that overlap.

    Null and empty texts overlap with nothing; items of one to five tokens only with documents that hold them whole. Among runs of equal matches the one first in
    the document is reported. Repeated rows report each; a null doc_id or item_id is carried. Other columns are ignored, but for
    ``keys``, whole numbers that are returned instead of doc_id.
    """
    keys = keys or ["doc_id"]
    docs = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], spelled(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), spelled(F.col("text")).alias("text")).where("text is not null").distinct()
    kind = ", ".join(f"`{k}` long" for k in keys)
    rest = ["matches", "run_tokens", "doc_token", "item_token"]
    if items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n > BLOCK_BYTES:
        scratch = Scratch(spark, "decontam")
        items = scratch.write(items.withColumn("row", F.monotonically_increasing_id()), "items")
        numbered = scratch.write(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
        found = scratch.write(_by_shuffle(scratch, numbered.select("row", "text"), items.select("row", "text")), "found")
        return found.join(numbered.drop("text"), "row").join(items.select(F.col("row").alias("item"), "item_id"), "item").select(*keys, "item_id", *rest)
    part = items.collect()  # at most BLOCK_BYTES of text
    shared = spark.sparkContext.broadcast(Seeds(sorted(((r.item_id, r.text) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for lo, hi, data, offs in K.slices(batch.column(len(keys))):
                rows = list(overlaps(table, K.Words(data, offs, SEPARATOR)))
                if rows:
                    doc, item, *found = zip(*rows)
                    at = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo).take(at) for k in range(len(keys))], pa.array([table.ids[i] for i in item], pa.int64()), *[pa.array(x, pa.int64()) for x in found]], names=[*keys, "item_id", *rest])

    return docs.mapInArrow(run, f"{kind}, item_id long, matches long, run_tokens long, doc_token long, item_token long")
