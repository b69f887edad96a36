"""Continuous ingest: scored games against all that came before, with the state in Spark's state store.

Two operators keep state by key. By fingerprint: whether it has been accepted. By game: the best score that has been accepted. A batch touches the
keys of its own rows and no others, so its cost does not follow what has been seen. State and results are committed with the batch, so a
restart neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE = "fp string, gid string, evs double"
ROWS = "idx long, fp string, gid string, evs double, status string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that rows without a fingerprint, which share nothing, are dealt to.
LOOSE = 1024


class Fingerprints(StatefulProcessor):
    """Rows of one fingerprint: DUPLICATE after the first accepted one, REJECTED without a score, ERROR without a fingerprint; an accepted one has no status yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.exists()
        held = pd.concat(list(rows)).sort_values("idx", kind="stable")
        good = held["fp"].notna() & (held["evs"] > 0)
        status = pd.Series("REJECTED", held.index).mask(held["fp"].isna(), "ERROR").to_numpy()
        if key[0] is not None and not held["fp"].isna().all():
            taken = good.to_numpy().cumsum()
            status = ["ERROR" if f else "DUPLICATE" if seen or n - g > 0 else None if g else s for s, f, n, g in zip(status, held["fp"].isna(), taken, good)]
            if not seen and good.any():
                self.seen.update((True,))
        yield held.assign(status=status)[["idx", "fp", "gid", "evs", "status"]]

    def close(self) -> None:
        pass


class Versions(StatefulProcessor):
    """Accepted rows of one game in order: NEW GAME, then UPGRADE if better than all before, else VERSION. Other rows pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "best double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = initialState["evs"].max()
        best = self.best.get()[0] if self.best.exists() else known
        self.best.update((float(max(best, known)),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = []
        for part in rows:
            yield part[part["status"].notna()]
            held.append(part[part["status"].isna()])
        accepted = pd.concat(held).sort_values("idx", kind="stable")
        if len(accepted):
            before = self.best.get()[0] if self.best.exists() else None
            prior = accepted["evs"].cummax().shift()
            prior = prior if before is None else prior.fillna(before).clip(lower=before)
            status = ["NEW GAME" if pd.isna(p) else "UPGRADE" if e > p else "VERSION" for e, p in zip(accepted["evs"], prior)]
            top = float(accepted["evs"].max())
            self.best.update((top if before is None else max(top, before),))
            yield accepted.assign(status=status)

    def close(self) -> None:
        pass


def classified(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A stream of (idx, fp, gid, evs) with ``status``, against ``known`` (fp, gid, evs), which the first batch starts from.

    Rows of a batch count in the order of idx, batches in the order they come. Null scores are 0; null games are one game. A batch's rows of one
    key are held in one task, so ``files_per_batch`` bounds them.
    """
    rows = rows.select(F.col("idx").cast("long").alias("idx"), "fp", F.coalesce("gid", F.lit("")).alias("gid"), F.coalesce(F.col("evs").cast("double"), F.lit(0.0)).alias("evs"))
    rows = rows.withColumn("key", F.coalesce("fp", F.concat(F.lit("?"), F.pmod("idx", F.lit(LOOSE)).cast("string"))))
    prints = games = None
    if known is not None:
        prints = known.where("fp is not null").select(F.col("fp").alias("key")).distinct().groupBy("key")
        games = known.where("evs is not null").select(F.coalesce("gid", F.lit("")).alias("gid"), "evs").groupBy("gid").agg(F.max("evs").alias("evs")).groupBy("gid")
    first = rows.groupBy("key").transformWithStateInPandas(Fingerprints(), ROWS, "append", "none", prints)
    return first.groupBy("gid").transformWithStateInPandas(Versions(), ROWS, "append", "none", games)


def ingest(spark: SparkSession, source: str, schema: StructType | str, state: str | None, output: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Files of rows (idx, fp, gid, evs) that appear in ``source`` get a status and are appended to ``output``.

    ``state``, a folder of rows (fp, gid, evs) accepted elsewhere, is what the first batch starts from; it is only read. A run goes through what there is
    and ends; the next, on the same ``checkpoint``, goes on from there.
    """
    session = spark.newSession()  # the store is chosen for this query alone
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = session.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    known = session.read.schema(STATE).parquet(state) if state else None
    out = classified(stream.parquet(source), known)
    return out.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
