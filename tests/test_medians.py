"""Medians of large groups against sorting, whatever may be held at once."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus
from lectern.sources import pgn


@pytest.mark.parametrize("most", [7, 10**6])
def test_as_sorting(spark, most):
    r = random.Random(most)
    groups = {
        "even": [r.random() for _ in range(200)], "odd": [r.gauss(0, 1e6) for _ in range(151)], "same": [2.5] * 90, "two": [1.0] * 50 + [9.0] * 50, "wide": [10.0 ** r.randrange(-300, 300) * r.choice([-1, 1]) for _ in range(120)],
        "close": [1.0, 1.0 + 2**-52] * 40 + [1.0 + 2**-52], "one": [4.0], None: [float(i) for i in range(77)], "ends": [-1.7e308, 1.7e308, 0.0] * 30 + [5.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    r.shuffle(rows)
    got = {x.g: x.median for x in corpus.medians(spark.createDataFrame(rows, "g string, x double"), "g", "x", most).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(median(vs), rel=1e-12), g


def test_a_large_group(spark):
    d = spark.range(500_000).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**15)).cast("double").alias("x")).unionByName(spark.createDataFrame([("h", 1.0)], "g string, x double"))
    want = {r.g: r.m for r in d.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()}
    assert {r.g: r.median for r in corpus.medians(d, "g", "x", 5000).collect()} == want


def test_header_values_are_trimmed(spark):
    r = spark.createDataFrame([('[Event " Foo  "]\n[Site "  "]',)], "raw string")
    assert tuple(r.select(*[pgn.header(F.col("raw"), t) for t in ("Event", "Site", "Date")]).first()) == ("Foo", "", "Unknown")
