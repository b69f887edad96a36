"""Many terms at once against counting each on its own, and the cost of a hundred times as many."""

import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.functions import patterns, text as X
from lectern.functions.patterns import Patterns


def counted(terms, texts):
    p = Patterns(terms)
    return {(int(t), p.terms[k]): int(n) for t, k, n in zip(*p.counts(pa.array(texts, pa.string())))}


def brute(terms, texts):
    return {(i, t): n for i, x in enumerate(texts) for t in {*terms} - {""} if (n := (x or "").count(t))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé 漢", max_size=4), min_size=1, max_size=10), st.lists(st.none() | st.text("abé 漢", max_size=30), max_size=6))
def test_equal_to_counting_each(terms, texts):
    assert counted(terms, texts) == brute(terms, texts)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_of_any_size(monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK", block)
    r = random.Random(block)
    texts = ["".join(r.choices("aab ", k=r.randrange(50))) for _ in range(20)] + [None, "", "a" * 100]
    terms = ["a", "aa", "aaa", "ab", "ba b", "b a", "aab aab", "zz"]
    assert counted(terms, texts) == brute(terms, texts)
    assert counted(terms, texts[5:9]) == brute(terms, texts[5:9]) and counted([], texts) == {} and counted(terms, []) == {}


def test_terms_of_one_hash(monkeypatch):
    monkeypatch.setattr(patterns, "_BYTE", patterns._BYTE * 0)
    texts, terms = ["abc bca cab abcabc", "cb"], ["abc", "bca", "cab", "ab", "cb"]
    assert counted(terms, texts) == brute(terms, texts)


def test_slices_of_a_column():
    column = pa.array(["ab", None, "abab", "xab"]).slice(1)
    p = Patterns(["ab"])
    assert [c.tolist() for c in p.counts(column)] == [[1, 2], [0, 0], [2, 1]]


def test_columns(spark):
    d = spark.createDataFrame([("Plan the plan, in the plans",), ("",), (None,), ("The point is weak because",)], "t string")
    rows = d.select(X.vocabulary_score(F.col("t"), {"in_the": 5, "plan": 3}).alias("v"), X.tier_weight(F.col("t")).alias("w"), X.cue_score(F.col("t")).alias("c")).collect()
    assert [r.v for r in rows] == [100.0, 0.0, 0.0, 0.0]
    assert [r.w for r in rows] == [2.0, 0.0, 0.0, pytest.approx(2.2)] and [r.c for r in rows] == [2.5, 0.0, 0.0, 2.5]


def test_cost_of_five_thousand_terms():
    r = random.Random(1)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randrange(3, 13)))
    texts = pa.array([" ".join(word() for _ in range(400)) for _ in range(600)])
    many = [word() for _ in range(5000)]
    few = [next(w for w in many if len(w) == 3 + i % 10) for i in range(10)] + many[:40]

    def seconds(terms):
        p = Patterns(terms)
        p.counts(texts)
        began = time.process_time()
        p.counts(texts)
        return time.process_time() - began

    assert min(seconds(many) for _ in range(3)) <= 2.5 * min(seconds(few) for _ in range(3))


def test_memory_of_long_columns():
    """A column of many megabytes takes no more memory than a block of it, and terms are present once though their text goes on in other blocks."""
    import tracemalloc

    weights = {"ab": 2, "ba": 3, "aba": 5, "b a": 7, "zz": 11}
    text = "abab a ba " * 500_000
    texts, total = pa.array([text, None, "zz", text]), sum(w * text.count(t) for t, w in weights.items())
    every, once = patterns._summed(weights, pa.int64(), False), patterns._summed({t: float(w) for t, w in weights.items()}, pa.float64(), True)
    tracemalloc.start()
    assert every(texts).to_pylist() == [total, None, 11, total]
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert once(texts).to_pylist() == [17.0, None, 11.0, 17.0]
