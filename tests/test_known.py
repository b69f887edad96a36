"""Look-ups by the membership filter against the plain join, and how much of the state they read."""

from pyspark.sql import functions as F

from lectern.sources import known
from lectern.sources.known import Known


def prints(spark, start, end):
    return spark.range(start, end).select(F.sha2(F.col("id").cast("string"), 256).alias("fp"), F.lit("g").alias("gid"), F.lit(1.0).alias("evs"))


def test_as_the_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known, "FOLDER_ROWS", 50)
    state = Known(spark, str(tmp_path / "k"))
    new = prints(spark, 0, 30).unionByName(prints(spark, 50_000, 50_020)).withColumn("n", F.lit(1))
    assert state.look_up(new).rows.where("known").count() == 0
    state.append(prints(spark, 10, 3010), "a")
    state.append(prints(spark, 5, 10).unionByName(spark.createDataFrame([(None, "g", 1.0)], known.STATE)), "b")
    state.append(prints(spark, 3000, 3005), "c")
    state.append(prints(spark, 0, 3), "c")  # written again: in place of its first attempt
    assert state.rows().count() == 3008
    found = state.look_up(new)
    want = {r.fp: r.m is not None for r in new.join(state.rows().select("fp", F.lit(1).alias("m")).distinct(), "fp", "left").collect()}
    assert {r.fp: r.known for r in found.rows.collect()} == want and sum(want.values()) == 28 and found.rows.columns == ["fp", "gid", "evs", "n", "known"]
    assert 3 <= found.read <= 30 < found.folders  # 28 known ones, of some 66 folders
    none = state.look_up(prints(spark, 90_000, 90_010))
    assert none.rows.where("known").count() == 0 and none.read <= 3
    repeated = spark.createDataFrame([(None,), ("x",), ("x",)], "fp string")
    assert [r.known for r in state.look_up(repeated).rows.collect()] == [False] * 3


def test_filter_has_few_false_hits(spark, tmp_path):
    state = Known(spark, str(tmp_path / "k"))
    state.append(prints(spark, 0, 20_000), "a")
    b = state.batches["a"]
    bits = spark.read.parquet(f"{state.path}/filters/{b['name']}")
    hit = lambda d: d.withColumns({"word": known._word(b["words"]), "mask": known._mask()}).join(bits, "word").where((F.col("bits").bitwiseAND(F.col("mask"))) == F.col("mask")).count()
    assert hit(prints(spark, 0, 20_000)) == 20_000 and hit(prints(spark, 100_000, 120_000)) < 0.02 * 20_000
    assert bits.count() <= 5000
