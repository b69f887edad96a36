"""Fingerprints that are known, in batches with a membership filter each.

A batch is its rows in folders by hash, and a blocked Bloom filter: rows (word, bits) of 64 bits, of which each fingerprint sets BITS in one word.
So a look-up is one join of new fingerprints with the filter's rows, a tenth of what the state is, and then reads those folders of the state
that may hold one of them. The join and the exact one after it are Spark's own, of any size.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .files import Log

#: Fingerprints for each word of a filter, bits that each sets, rows that a folder is made for, folders at most.
KEYS_PER_WORD, BITS, FOLDER_ROWS, MOST_FOLDERS = 4, 5, 50_000, 4096
STATE = "fp string, gid string, evs double"


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64("fp"), F.lit(words))


def _mask() -> Column:
    """BITS bits of the word of a fingerprint, by a hash of its own."""
    h = F.xxhash64(F.lit("bits"), "fp")
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return out


def _folder(folders: int) -> Column:
    return F.pmod(F.crc32(F.col("fp").cast("binary")), F.lit(folders)).cast("int")


@dataclass
class Found:
    """``rows`` with ``known``; folders of the state that were read, of how many."""

    rows: DataFrame
    read: int
    folders: int


class Known:
    """The state at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, path)

    def append(self, rows: DataFrame, batch: str) -> None:
        """``rows`` (fp, gid, evs) as a batch; one of a name that is there takes its place. Rows without a fingerprint are left out."""
        name = uuid.uuid4().hex[:12]
        rows = rows.select("fp", "gid", F.col("evs").cast("double").alias("evs")).where("fp is not null")
        staged = f"{self.path}/staged/{name}"
        rows.write.parquet(staged)
        rows = self.spark.read.schema(STATE).parquet(staged)
        n = rows.count()
        folders = min(MOST_FOLDERS, 1 << max(0, math.ceil(math.log2(max(1, n) / FOLDER_ROWS))))
        words = max(1, n // KEYS_PER_WORD)
        rows.withColumn("folder", _folder(folders)).repartition("folder").sortWithinPartitions("folder", "fp").write.partitionBy("folder").parquet(f"{self.path}/rows/{name}")
        bits = rows.select(_word(words).alias("word"), _mask().alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
        bits.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{self.path}/filters/{name}")
        there = [r.folder for r in self.spark.read.schema("folder int").parquet(f"{self.path}/rows/{name}").distinct().collect()] if n else []
        entry = {"name": name, "words": words, "folders": folders, "there": sorted(there), "rows": n}
        self.log.update(lambda content: {**content, "batches": {**content.get("batches", {}), batch: entry}})

    @property
    def batches(self) -> dict[str, dict]:
        return self.log.latest()[1].get("batches", {})

    def rows(self) -> DataFrame:
        found = [self.spark.read.schema(STATE).parquet(f"{self.path}/rows/{b['name']}").drop("folder") for b in self.batches.values() if b["rows"]]
        return _union(found) if found else self.spark.createDataFrame([], STATE)

    def look_up(self, new: DataFrame) -> Found:
        """``new`` (fp and other columns) with ``known``, whether a batch has its fingerprint. A null fingerprint is not known."""
        prints = new.select("fp").where("fp is not null").distinct()
        hits, read, total = [], 0, 0
        for b in (b for b in self.batches.values() if b["rows"]):
            asked = prints.withColumns({"word": _word(b["words"]), "mask": _mask(), "folder": _folder(b["folders"])})
            filtered = asked.join(self.spark.read.schema("word long, bits long").parquet(f"{self.path}/filters/{b['name']}"), "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
            wanted = sorted({r.folder for r in filtered.select("folder").distinct().collect()} & {*b["there"]})  # MOST_FOLDERS at most
            total, read = total + len(b["there"]), read + len(wanted)
            if wanted:
                hits.append(self.spark.read.schema(STATE).parquet(*[f"{self.path}/rows/{b['name']}/folder={f}" for f in wanted]).select("fp"))
        found = _union(hits).distinct().withColumn("known", F.lit(True)) if hits else None
        rows = new.withColumn("known", F.lit(False)) if found is None else new.join(found, "fp", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        return Found(rows, read, total)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
