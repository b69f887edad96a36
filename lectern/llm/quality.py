"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features describe it and its two neighbours; the chain's
transitions couple consecutive labels. Training maximises the likelihood of line labels inherited from
labelled documents, on a bounded sample; a document's quality is the length-weighted mean of the
forward-backward marginals of "good", mapped to a probability by a monotone logistic curve that is
fitted on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernel as K
from .langid import held_out

#: Bounds of what the fit sees: labelled documents, and their lines.
SAMPLE, SAMPLE_LINES = 4000, 400_000
STEPS = 120
RATE = 0.1
PENALTY = 1e-3
LINE = np.zeros(256, dtype=bool)
LINE[10] = True
_letter, _upper, _digit, _mark, _symbol = (np.zeros(256, dtype=bool) for _ in range(5))
_letter[65:91] = _letter[97:123] = True
_letter[128:] = True
_upper[65:91] = True
_digit[48:58] = True
_mark[[ord(c) for c in "!?"]] = True
_symbol[[ord(c) for c in "#$%&*|<>{}[]@^~=_\\/+"]] = True
OWN = 15


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (lines, OWN), line lengths in bytes, first line of each text) of a slice.

    Lines end at newlines; every text, the empty one too, has at least one line.
    """
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offs, breaks, side="right") - 1
    begins = np.sort(np.concatenate([offs[:-1], breaks + 1])) if len(breaks) else offs[:-1].copy()
    counts = np.bincount(owner, minlength=len(offs) - 1) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    ends = np.empty(len(begins), dtype=np.int64)
    ends[:-1] = begins[1:] - 1
    last = first[1:] - 1
    ends[last] = offs[1:]
    begins = np.minimum(begins, ends)
    lens = ends - begins

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return (total[ends] - total[begins]).astype(np.float64)

    letters, upper, digits, marks, symbols = (share(m) for m in (_letter, _upper, _digit, _mark, _symbol))
    size = np.maximum(lens, 1)
    w = K.Words(data, offs)
    a, b = np.searchsorted(w.start, begins), np.searchsorted(w.start, ends)
    n = b - a
    words = np.maximum(n, 1)

    def of_words(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[b] - total[a]).astype(np.float64) / words

    again = np.zeros(len(w.hash), dtype=bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    tail = _symbol[data[w.end - 1]] | _mark[data[w.end - 1]] if len(w.hash) else again
    single = (w.end - w.start) == 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(w.hash, dtype=np.uint64)])
    key = sums[b] - sums[a]
    line_of = np.repeat(np.arange(len(begins)), n)
    order = np.lexsort((w.hash, line_of))
    new = np.ones(len(w.hash), dtype=bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order][new], minlength=len(begins)) / words
    doc = np.repeat(np.arange(len(counts)), counts)
    _, inverse, times = np.unique(K.mix(key) + K.mix(doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    ended = np.zeros(len(begins))
    full = lens > 0
    ended[full] = np.isin(data[ends[full] - 1], [ord(c) for c in ".!?:;\""])
    capital = np.zeros(len(begins))
    capital[full] = _upper[data[begins[full]]] | (data[begins[full]] >= 128)
    x = np.column_stack([
        np.log1p(lens) / 5, letters / size, upper / np.maximum(letters, 1), digits / size, marks / size, symbols / size,
        share(~K.SPACE) / words / 10, of_words(again), distinct, 1.0 - 1.0 / times[inverse],
        ended, capital, of_words(tail), of_words(single), (lens == 0).astype(float),
    ])
    return x, lens, first


def expand(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's own features, their square roots, and both neighbours'; zeros beyond the text's ends."""
    prev, nxt = np.zeros_like(x), np.zeros_like(x)
    prev[1:], nxt[:-1] = x[:-1], x[1:]
    prev[first[:-1]] = 0
    nxt[first[1:] - 1] = 0
    return np.hstack([np.ones((len(x), 1)), x, np.sqrt(np.maximum(x, 0)), prev, nxt])


def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and by text the expected transitions (texts, 2, 2) if ``pairs``.

    ``unary`` is each line's score of "good" against 0 for "bad"; texts run in lockstep, longest first.
    """
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    begin, size = first[:-1][order], lens[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with a line t
    psi = np.exp(trans - trans.max())
    e = np.column_stack([np.exp(np.minimum(-unary, 0)), np.exp(np.minimum(unary, 0))])  # bad, good
    f, bwd = np.zeros((len(unary), 2)), np.ones((len(unary), 2))
    for t in range(longest):
        i = begin[: active[t]] + t
        v = e[i] if t == 0 else (f[i - 1] @ psi) * e[i]
        f[i] = v / v.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        v = (bwd[i + 1] * e[i + 1]) @ psi.T
        bwd[i] = v / v.sum(axis=1, keepdims=True)
    post = f * bwd
    post /= post.sum(axis=1, keepdims=True)
    moved = np.zeros((len(lens), 2, 2))
    if pairs and len(unary) > 1:
        inner = np.ones(len(unary), dtype=bool)
        inner[first[1:] - 1] = False
        i = np.flatnonzero(inner)
        joint = f[i][:, :, None] * psi[None] * (e[i + 1] * bwd[i + 1])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        np.add.at(moved, (np.repeat(np.arange(len(lens)), lens))[i], joint)
    return post[:, 1], moved


def aggregate(good: np.ndarray, lens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals for each text; an empty line weighs 1."""
    weight = np.maximum(lens, 1).astype(float)
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def score(self, x: np.ndarray, lens: np.ndarray, first: np.ndarray) -> np.ndarray:
        unary = ((expand(x, first) - self.centre) / self.spread) @ self.weights
        good, _ = marginals(np.clip(unary, -30, 30), self.trans, first)
        return _logistic(self.slope * _logit(aggregate(good, lens, first)) + self.shift)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, lens: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
    """Penalised conditional likelihood by Adam; every document weighs the same whatever its number of lines."""
    z = expand(x, first)
    centre, spread = z.mean(axis=0), z.std(axis=0)
    centre[0], spread[0] = 0.0, 1.0
    spread[spread < 1e-6] = 1.0
    z = (z - centre) / spread
    n = np.diff(first)
    each = np.repeat(1.0 / n, n) / len(n)
    labels = np.repeat(y, n).astype(float)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((len(n), 2, 2))
    seen[np.arange(len(n)), y, y] = n - 1
    for step in range(1, STEPS + 1):
        trans = theta[-4:].reshape(2, 2)
        good, moved = marginals(np.clip(z @ theta[:-4], -30, 30), trans, first, pairs=True)
        grad = np.concatenate([z.T @ ((labels - good) * each), ((seen - moved) / n[:, None, None]).mean(axis=0).ravel()]) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    trans = theta[-4:].reshape(2, 2)
    good, _ = marginals(np.clip(z @ theta[:-4], -30, 30), trans, first)
    raw = _logit(aggregate(good, lens, first))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton, with a small ridge
        p = _logistic(slope * raw + shift)
        g = np.array([((y - p) * raw).sum() - 0.1 * (slope - 1), (y - p).sum() - 0.1 * shift])
        h = p * (1 - p)
        hess = np.array([[(h * raw * raw).sum() + 0.1, (h * raw).sum()], [(h * raw).sum(), h.sum() + 0.1]])
        move = np.clip(np.linalg.solve(hess, g), -0.5, 0.5)
        slope, shift = max(0.02, slope + move[0]), shift + move[1]
    return Model(centre, spread, theta[:-4], trans, float(slope), float(shift))


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in K.slices(batch.column(2)):
            x, lens, first = line_features(data, offs)
            x = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()), pa.array([lens[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                names=["doc_id", "quality", "x", "lens"],
            )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from the ``sample`` rows of ``labels`` (doc_id, quality) of least hash that are not held out, up to SAMPLE_LINES lines.

    A document's label is that of all its lines, so transitions learn how far labels persist, no more.

    Null labels and documents with conflicting labels are passed over. None if nothing is left.
    """
    usable = labels.where(~held_out("doc_id", 3, 1) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    place = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(place, "doc_id").limit(sample)
    # at most ``sample`` rows of 12 bytes
    joined = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    seen = joined.mapInArrow(_sample_batches, "doc_id long, quality int, x binary, lens binary")
    # one text of a repeated doc_id, and in the order of the hash, so that neither bound depends on how rows arrive
    rows = seen.groupBy("doc_id", "quality").agg(F.min(F.struct("lens", "x")).alias("r")).select("doc_id", "quality", "r.*").orderBy(place, "doc_id")
    found, lines = [], 0
    for r in rows.toLocalIterator():
        if lines >= SAMPLE_LINES:
            break
        found.append(r)
        lines += len(r.lens) // 4
    rows = sorted(found, key=lambda r: r.doc_id)
    if not rows:
        return None
    x = np.concatenate([np.frombuffer(r.x, dtype=np.float32).reshape(-1, OWN) for r in rows]).astype(float)
    parts = [np.frombuffer(r.lens, dtype=np.int32) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return train(x, np.concatenate(parts).astype(np.int64), first, np.array([r.quality for r in rows]))


def scored(spark: SparkSession, rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` (other columns and text) plus score; text is dropped. Without a model every score is 0.5."""
    keys = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in keys]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score = np.full(len(batch), 0.5)
            if m is not None:
                for lo, hi, data, offs in K.slices(batch.column(len(names))):
                    score[lo:hi] = m.score(*line_features(data, offs))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(score)], names=[*names, "score"])

    return rows.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"{kind}, score double")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), learned from ``labels``.

    Null and empty texts are one empty line and get that line's score. No labels: 0.5 and 1 everywhere. Null doc_id:
    not held out. Repeated rows are scored alike; a table without rows gives none; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), sample)
    out = scored(spark, docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text"), model)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
