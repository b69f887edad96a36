"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is folded to lower-case letters with single spaces between runs of anything else; its n-grams of 1 to 3
characters are hashed into BUCKETS features. TF is a count over the text's n-grams, IDF comes from the
document frequencies over all training documents. Weights are learned by follow-the-regularised-leader
(FTRL-proximal) with L1 and L2 penalties on a bounded sample of the training rows, then one temperature is
calibrated on a part of the sample that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernel as K

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bounds of the labelled sample that the fit sees, in rows and in bytes of features; document frequencies use all training rows.
SAMPLE, SAMPLE_BYTES = 3000, 128 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
#: TF-IDF values are shares of a text; this factor brings them near 1.
SCALE = 30.0
UNDETERMINED = "und"
GRAM = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        _fold = table
    return _fold


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket of every n-gram, text of every n-gram's bounds, n-grams of each text) by slices."""
    for lo, hi, data, offs in K.slices(column, K.SLICE_BYTES // 2):
        lead = (data & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[offs]
        codes = fold_table()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        keep[at[:-1][at[:-1] < len(codes)]] = True
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        codes = codes[keep]
        lens = np.diff(at)
        left = np.repeat(at[1:], lens) - np.arange(len(codes))
        parts, total = [], np.zeros(hi - lo, dtype=np.int64)
        acc = np.zeros(len(codes), dtype=np.uint32)
        for n in ORDERS:
            acc = acc.copy()
            acc[: len(codes) - n + 1] += codes[n - 1 :] * GRAM[n - 1]
            h = acc ^ (acc >> np.uint32(15))
            h = (h + GRAM[n - 1 : n]) * GRAM[1]
            bucket = (h >> np.uint32(16)).astype(np.int32)
            bucket[left < n] = BUCKETS  # crosses the text's end
            parts.append(bucket)
            total += np.maximum(lens - n + 1, 0)
        yield lo, hi, np.stack(parts), at, total


def _statistics() -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Document frequencies of the partition, and the features of sampled rows."""
        seen = np.zeros(BUCKETS + 1, dtype=np.int64)
        rows = 0
        for batch in batches:
            lang, places, text = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for lo, hi, buckets, at, _ in features(text):
                langs, at_, ids, counts = [], [], [], []
                owner = np.tile(np.repeat(np.arange(hi - lo), np.diff(at)), len(buckets))
                key, times = np.unique(owner * (BUCKETS + 1) + buckets.ravel(), return_counts=True)
                inside = key % (BUCKETS + 1) < BUCKETS
                key, times = key[inside], times[inside].astype(np.uint32)
                bucket = key % (BUCKETS + 1)
                seen[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                rows += hi - lo
                first = np.searchsorted(key, np.arange(hi - lo + 1) * (BUCKETS + 1))
                for d in range(hi - lo):
                    if places[lo + d] is not None:
                        langs.append(lang[lo + d].as_py())
                        at_.append(places[lo + d])
                        ids.append(bucket[first[d] : first[d + 1]].astype(np.uint16).tobytes())
                        counts.append(times[first[d] : first[d + 1]].tobytes())
                if langs:
                    yield _row(langs, at_, ids, counts)
        seen[BUCKETS] = rows
        nz = np.flatnonzero(seen)
        if len(nz):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(nz), pa.string()), pa.nulls(len(nz), pa.int64()), pa.nulls(len(nz), pa.binary()), pa.nulls(len(nz), pa.binary()), pa.array(nz), pa.array(seen[nz])], names=["lang", "place", "ids", "counts", "bucket", "df"])

    def _row(langs, places, ids, counts):
        n = len(langs)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["lang", "place", "ids", "counts", "bucket", "df"])

    return run


@dataclass
class Model:
    """Learned languages, weights with IDF folded in (BUCKETS + 1, languages), bias and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal for the multinomial logistic loss; rows are (feature ids, values, class)."""
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            ids, x, y = rows[k]
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            root = np.sqrt(ni + g * g)
            z[ids] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[ids] = ni + g * g
    return weights(z, n)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean() + 1e-4 * t * t

    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _valid(name: str) -> F.Column:
    """The text, empty for null; bytes that are not UTF-8 become replacement characters."""
    return F.coalesce(F.make_valid_utf8(F.col(name).cast("string")), F.lit(""))


def fit(train: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from ``train`` (key, lang, text); None without labelled rows.

    The sample is the ``sample`` rows of least hash of key, in the order of the hash and up to SAMPLE_BYTES of features,
    so it does not depend on how rows arrive.
    """
    train = train.where("lang is not null")
    total = train.count()
    if not total:
        return None
    share = min(1.0, 1.2 * sample / total + 50 / total)
    edge = int(-(2**63) + share * (2**64 - 1))
    place = F.xxhash64(F.col("key").cast("string"))
    place = F.when(place <= F.lit(min(edge, 2**63 - 1)).cast("long"), place)
    found = train.select("lang", place.alias("place"), _valid("text").alias("text")).mapInArrow(_statistics(), "lang string, place long, ids binary, counts binary, bucket long, df long")
    merged = found.groupBy("lang", "place", "ids", "counts", "bucket").agg(F.sum("df").alias("df"), F.count("*").alias("times"))
    frequency = np.zeros(BUCKETS + 1)
    raw, size = [], 0
    for r in merged.orderBy("place", "lang", "ids", "counts", "bucket").toLocalIterator():  # document frequencies first, at most BUCKETS + 1 rows
        if r.bucket is not None:
            frequency[r.bucket] = r.df
        elif len(raw) < sample and size < SAMPLE_BYTES:
            raw += [(r.lang, r.ids, r.counts)] * min(r.times, sample - len(raw))
            size += len(r.ids) + len(r.counts)
        else:
            break
    raw = sorted(raw)
    idf = np.append(np.log((1 + frequency[BUCKETS]) / (1 + frequency[:BUCKETS])) + 1, 0.0)
    languages = sorted({x[0] for x in raw})
    rows = []
    for lang, ids, counts in raw:
        i = np.frombuffer(ids, dtype=np.uint16).astype(np.int64)
        c = np.frombuffer(counts, dtype=np.uint32).astype(np.float64)
        x = c / max(1.0, c.sum()) * idf[i] * SCALE
        rows.append((np.append(i, BUCKETS), np.append(x, 1.0), languages.index(lang)))
    order = np.random.default_rng(5).permutation(len(rows))
    held = order[: len(rows) // 5]
    used = order[len(rows) // 5 :]
    w = ftrl([rows[k] for k in used], BUCKETS + 1, len(languages))
    logits = np.array([rows[k][1] @ w[rows[k][0]] for k in held]).reshape(len(held), len(languages))
    t = calibrate(logits, np.array([rows[k][2] for k in held], dtype=np.int64))
    folded = w * (idf * SCALE)[:, None]
    folded[BUCKETS] = 0
    return Model(languages, folded.astype(np.float32), w[BUCKETS], t)


def predict(spark: SparkSession, rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` (row columns and text) plus lang_pred and score; text is dropped.

    Null text, or text without a letter, or no model: ``und`` with score 0. Ties go to the language first in order.
    The model broadcast is bounded by (BUCKETS + 1) x languages x 4 bytes.
    """
    keys = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in keys]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = batch.column(len(names))
            pred, score = np.full(len(batch), -1), np.zeros(len(batch))
            if m is not None:
                for lo, hi, buckets, at, total in features(text):
                    z = np.zeros((hi - lo, len(m.languages)))
                    full = np.flatnonzero(np.diff(at))
                    if len(full):
                        for b in buckets:
                            z[full] += np.add.reduceat(m.weights[b], at[:-1][full], axis=0)
                    p = _softmax((z / np.maximum(total, 1)[:, None] + m.bias) / m.temperature)
                    pred[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            has = np.array([bool(x) for x in batch.column(len(names) + 1).to_pylist()], dtype=bool)
            pred[~has] = -1
            langs = pa.array([m.languages[i] if i >= 0 else UNDETERMINED for i in pred], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], langs, pa.array(np.where(pred >= 0, score, 0.0))], names=[*names, "lang_pred", "score"])

    text = _valid("text")
    return rows.select(*[F.col(f"`{n}`") for n in names], text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letters")).mapInArrow(run, f"{kind}, lang_pred string, score double")


def held_out(key: str, parts: int, part: int) -> F.Column:
    """Whether a row's remainder of crc32 of its key as text is ``part``; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Learns from rows with a language that are not held out (crc32 of doc_id modulo 5 not 0). Null text or no letter:
    ``und``, score 0. Null doc_id: not held out. No labelled rows at all: everything is ``und``. Repeated rows and
    empty tables need no care; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model = fit(docs.where("not held_out").select(F.col("doc_id").alias("key"), "lang", "text"), sample)
    return predict(spark, docs.select("doc_id", "held_out", "text"), model)
