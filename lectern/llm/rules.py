"""Quality rules: gradient-boosted trees over statistics of a document.

Statistics are counted where a text is read. A sample of labelled documents trains trees of logistic loss by Newton steps over
histograms. On the features of MONOTONE a split may only lower the score to its right, and the leaves on both sides stay on their side of the
middle, so the score never rises with one of them. The trees are flattened into node arrays (feature, threshold, children, value), through which
all documents of a batch go together, a level of all trees at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernel as K
from .divergence import words_of
from .runs import AS_IS

#: Labelled documents that the fit sees, at most: those of least hash.
SAMPLE = 4000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 80, 3, 64, 0.2, 1.0, 1.0
#: A document with fewer words, or with more of its words in repeated windows than this percentage, fails whatever its score.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeat_words", "marks", "capitals", "digits", "distinct_words", "line_words", "ended_lines"]
#: The score never rises with these.
MONOTONE = {"symbols", "dup_lines", "repeat_words", "marks"}


def _listed(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


SYMBOL, MARK, DIGIT, STOP = _listed("#*$%&|<>"), _listed("!?"), _listed("0123456789"), _listed(".!?:;\"")
CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[65:91] = True
LETTER = CAPITAL | np.roll(CAPITAL, 32)


def repeated(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of WINDOW words that its text holds twice or more."""
    n, out = len(ids), np.zeros(len(ids), dtype=bool)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.repeat(first[1:], counts) - np.arange(n) >= WINDOW)
    if len(at) < 2:
        return out
    columns = [doc[at], *[ids[at + j] for j in range(WINDOW)]]
    h = np.zeros(len(at), dtype=np.uint64)
    for j, c in enumerate(columns):
        h += c.astype(np.uint64) * K.STEP[j]
    h = K.mix(h)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    equal = np.ones(len(at) - 1, dtype=bool)
    for c in columns:
        equal &= c[order][1:] == c[order][:-1]
    if (same & ~equal).any():  # windows that share a hash: sorted by their words instead
        order = np.lexsort(columns)
        equal = np.ones(len(at) - 1, dtype=bool)
        for c in columns:
            equal &= c[order][1:] == c[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    for j in range(WINDOW):
        out[at[twice] + j] = True
    return out


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS of every text of a slice, whole numbers; FEATURES)."""
    texts = len(offs) - 1

    def of_texts(mask: np.ndarray, at: np.ndarray = offs) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])[at]
        return total[1:] - total[:-1]

    found, doc = words_of(data, offs, K.SPACE, AS_IS)
    ids = found.indices.to_numpy().astype(np.int64)
    first = np.searchsorted(doc, np.arange(texts + 1))
    words = np.diff(first)
    in_word = ~K.SPACE[data]
    chars = of_texts(in_word & ((data & 0xC0) != 0x80))
    again = of_texts(repeated(ids, first), first)
    distinct = np.bincount(np.unique(doc * max(len(found.dictionary), 1) + ids) // max(len(found.dictionary), 1), minlength=texts)

    # lines: a break ends one, and so does a text
    breaks = np.flatnonzero(data == 10)
    cuts = np.sort(np.concatenate([breaks, offs[1:]]), kind="stable")
    owner = np.repeat(np.arange(texts), of_texts(data == 10) + 1)
    begin = np.empty(len(cuts), dtype=np.int64)
    begin[1:] = cuts[:-1] + (owner[1:] == owner[:-1])
    begin[:1] = 0
    total = np.concatenate([[0], np.cumsum(in_word)])
    full = total[cuts] > total[begin]
    flat = data[data != 10]
    size = np.concatenate([[0], np.cumsum(cuts - begin)])
    line = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
    key = (owner * max(len(line.dictionary), 1) + line.indices.to_numpy())[full]
    lines = np.bincount(owner[full], minlength=texts)
    dup = lines - np.bincount(np.unique(key) // max(len(line.dictionary), 1), minlength=texts)
    last = np.searchsorted(np.flatnonzero(in_word), cuts[full], side="left") - 1
    ended = np.bincount(owner[full], STOP[data[in_word]][last], minlength=texts)

    counts = np.column_stack([words, chars, of_texts(SYMBOL[data]), dup, again]).astype(np.int64)
    w, c, l = (np.maximum(x, 1) for x in (words, chars, lines))
    letters = np.maximum(of_texts(LETTER[data]), 1)
    x = np.column_stack([
        np.log1p(words), chars / w, counts[:, 2] / w, dup / l, again / w, of_texts(MARK[data]) / w, of_texts(CAPITAL[data]) / letters,
        of_texts(DIGIT[data]) / c, distinct / w, words / l, ended / l,
    ])
    return counts, x


@dataclass
class Trees:
    """Nodes of all trees in arrays: a leaf is its own child. ``roots`` are the trees' first nodes, ``base`` the score without trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of features."""
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[a : a + 4096] = self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out + self.base, -40, 40)))


class _Grower:
    """Grows one tree on binned features into the node lists of a model."""

    def __init__(self, x: np.ndarray, monotone: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        self.binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)])
        self.monotone = monotone
        self.nodes: list[list[float]] = []  # feature, threshold, left, right, value

    def grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float, out: np.ndarray) -> int:
        """The node of ``rows`` with values between ``low`` and ``high``; adds its leaves' values to ``out``."""
        me = len(self.nodes)
        weight = lambda gs, hs: np.clip(-gs / (hs + RIDGE), low, high)
        gain_of = lambda gs, hs, v: -(gs * v + 0.5 * (hs + RIDGE) * v * v)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(weight(gs, hs))
        self.nodes.append([0, 0.0, me, me, value])
        best = (1e-6, 0, 0, 0.0, 0.0)
        if depth:
            for j, edges in enumerate(self.edges):
                size = len(edges) + 1
                lg = np.cumsum(np.bincount(self.binned[rows, j], g[rows], size))[:-1]
                lh = np.cumsum(np.bincount(self.binned[rows, j], h[rows], size))[:-1]
                vl, vr = weight(lg, lh), weight(gs - lg, hs - lh)
                gain = gain_of(lg, lh, vl) + gain_of(gs - lg, hs - lh, vr) - gain_of(gs, hs, value)
                ok = (lh >= LEAST_WEIGHT) & (hs - lh >= LEAST_WEIGHT)
                if self.monotone[j]:
                    ok &= vl >= vr
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        gain, j, k, vl, vr = best
        if gain <= 1e-6:
            out[rows] += RATE * value
            self.nodes[me][4] = RATE * value
            return me
        goes = self.binned[rows, j] <= k
        middle = (vl + vr) / 2
        bounds = ((middle, high), (low, middle)) if self.monotone[j] else ((low, high), (low, high))
        left = self.grow(rows[goes], g, h, depth - 1, *bounds[0], out)
        right = self.grow(rows[~goes], g, h, depth - 1, *bounds[1], out)
        self.nodes[me] = [j, float(self.edges[j][k]), left, right, 0.0]
        return me


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray | None = None, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for features ``x`` and labels 0 and 1; ``monotone`` marks features whose rise may not raise the score."""
    monotone = np.array([f in MONOTONE for f in FEATURES]) if monotone is None else monotone
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    grower, roots, z = _Grower(x, monotone), [], np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        roots.append(grower.grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf, z))
    f, t, l, r, v = (np.array(c) for c in zip(*grower.nodes))
    return Trees(f.astype(np.int64), t, l.astype(np.int64), r.astype(np.int64), v, np.array(roots), depth, base)


def passes(counts: np.ndarray) -> np.ndarray:
    """Texts that fail no base rule, from their COUNTS."""
    return (counts[:, 0] >= LEAST_WORDS) & (100 * counts[:, 4] <= MOST_REPEATED * counts[:, 0])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in K.slices(batch.column(2)):
            counts, x = statistics(data, offs)
            at = np.flatnonzero(passes(counts))
            take = lambda i: batch.column(i).slice(lo, hi - lo).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([take(0), take(1), pa.array(list(x[at]), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Learn from the ``sample`` rows of ``labels`` (doc_id, quality) of least hash whose ``docs`` pass the base rules.

    Null labels and documents with conflicting labels are passed over; of rows that repeat a doc_id the least features count. None if
    labels of only one kind are left.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most"))
    chosen = usable.where("quality = most").select("doc_id", "quality").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    # at most ``sample`` rows of 12 bytes
    joined = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    seen = joined.mapInArrow(_sampled, "doc_id long, quality int, x array<double>")
    rows = seen.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect()
    y = np.array([r.quality for r in rows])
    return train(np.array([r.x for r in rows]), y) if len(set(y.tolist())) == 2 else None


OUT = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"


def rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """OUT for every row of ``docs`` (doc_id, text), with a model learned from ``labels`` (doc_id, quality).

    ``kept`` is false where a base rule fails, else whether the score is 0.5 or more. Null, empty and blank texts have no words and fail.
    Without labels of both kinds the score is null and what passes the base rules is kept. Repeated rows are judged alike; no rows give none;
    other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), sample)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, offs in K.slices(batch.column(1)):
                counts, x = statistics(data, offs)
                ok = passes(counts)
                score = None if m is None else m.score(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(c) for c in counts.T.copy()], pa.array(~ok), pa.array(ok if score is None else ok & (score >= 0.5)), pa.nulls(hi - lo, pa.float64()) if score is None else pa.array(score)],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "score"],
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, OUT)
