"""Continuous ingest against the status machine row by row, over restarts, and against what was known before."""

import random

import pytest
from test_operators import sequential

from lectern.streaming.ingest import ingest

KIND = "idx long, fp string, gid string, evs double"


def run(spark, tmp_path, runs, known=None, per_batch=1):
    paths = {k: str(tmp_path / k) for k in ("in", "state", "out", "check")}
    if known:
        spark.createDataFrame(known, "fp string, gid string, evs double").write.parquet(paths["state"])
    queries = []
    for files in runs:
        for rows in files:
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(paths["in"])
        queries.append(ingest(spark, paths["in"], KIND, paths["state"] if known else None, paths["out"], paths["check"], per_batch))
        queries[-1].awaitTermination(300)
        assert queries[-1].exception() is None
    return {r.idx: r.status for r in spark.read.parquet(paths["out"]).collect()}, queries


def test_restarts(spark, tmp_path):
    got, _ = run(spark, tmp_path, [[[(1, "A", "g", 50.0), (2, "B", "g", 60.0)]], [[(3, "A", "g", 50.0), (4, "C", "g", 70.0), (5, None, "g", 9.0), (6, "D", None, None)]], []])
    assert got == {1: "NEW GAME", 2: "UPGRADE", 3: "DUPLICATE", 4: "UPGRADE", 5: "ERROR", 6: "REJECTED"}


@pytest.mark.parametrize("known", [[], [("F1", "g1", 30.0), ("F2", "g1", 80.0), ("F9", "g0", 5.0)]])
def test_as_row_by_row(spark, tmp_path, known):
    r = random.Random(4)
    rows = [(i, f"F{r.randrange(25)}", f"g{r.randrange(4)}", float(r.choice([0, 10, 20, 30, 40, 90]))) for i in range(120)]
    parts = [rows[i : i + 20] for i in range(0, 120, 20)]
    for p in parts:
        r.shuffle(p)
    got, queries = run(spark, tmp_path, [parts[:2], parts[2:3], parts[3:]], known)
    assert got == sequential(rows, known)
    # a batch changes the keys of its rows alone
    for q in queries:
        for p in q.recentProgress:
            assert all(o["numRowsUpdated"] <= 20 for o in p["stateOperators"])
