"""Keyed tables against a dictionary, with writers at once, and what a small change writes."""

import os
import random
import threading

from pyspark.sql import functions as F

from lectern.sources import keyed
from lectern.sources.keyed import KeyedTable

KIND = "file string, n int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def written(path):
    return {os.path.join(a, f) for a, _, fs in os.walk(os.path.join(path, "data")) for f in fs if f.endswith(".parquet")}


def test_as_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 4)
    monkeypatch.setattr(keyed, "FIRST_BUCKETS", 2)
    r, table, want = random.Random(1), KeyedTable(spark, str(tmp_path / "t"), "file"), {}
    assert table.read() is None and table.find(["a"]) is None
    for step in range(4):
        rows = [(f"f{r.randrange(40)}" if r.random() < 0.95 else None, r.randrange(1000)) for _ in range(15)]
        got = table.put(spark.createDataFrame(rows, KIND))
        for k in {k for k, _ in rows}:
            want[k] = max(n for f, n in rows if f == k)
        assert rows_of(got) == sorted(want.items(), key=repr)
    assert table.log.latest()[1]["buckets"] > 2 and rows_of(table.read(1)) != rows_of(table.read())
    assert rows_of(table.find(["f1", "f2", "none"])) == sorted((k, n) for k, n in want.items() if k in ("f1", "f2"))
    more = rows_of(table.put(spark.createDataFrame([("new", 1, "x")], KIND + ", extra string")).select("file", "n", "extra"))
    assert more == sorted([*[(k, n, None) for k, n in want.items()], ("new", 1, "x")], key=repr)
    assert rows_of(table.put(spark.createDataFrame([], KIND)).select("file", "n", "extra")) == more


def test_a_small_change_writes_little(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "file")
    table.put(spark.range(4000).select(F.concat(F.lit("f"), "id").alias("file"), F.col("id").cast("int").alias("n")))
    before = written(tmp_path / "t")
    table.put(spark.createDataFrame([("f7", -1)], KIND))
    fresh = written(tmp_path / "t") - before
    assert before <= written(tmp_path / "t") and 0 < spark.read.parquet(*fresh).count() <= 4000 / 16 * 1.5
    assert rows_of(table.find(["f7", "f8"])) == [("f7", -1), ("f8", 8)] and table.read().count() == 4000


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    parts = [[(f"f{i}", k) for i in range(10 * k, 10 * k + 15)] for k in range(3)]
    each = [threading.Thread(target=lambda p=p: KeyedTable(spark, path, "file").put(spark.createDataFrame(p, KIND))) for p in parts]
    [t.start() for t in each]
    [t.join() for t in each]
    got = dict(rows_of(KeyedTable(spark, path, "file").read()))
    assert set(got) == {k for p in parts for k, _ in p} and all((k, n) in sum(parts, []) for k, n in got.items())
