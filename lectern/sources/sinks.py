"""Writers of the results that leave the engine."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .keyed import KeyedTable


def write_chunks(chunks: DataFrame, path: str, statistics: DataFrame | None = None) -> None:
    """Chunks as JSON lines below ``path/chunks``, as many files as partitions; the run's statistics, one row, and the time of writing below ``path/stats``."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    if statistics is not None:
        statistics.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def write_kept(games: DataFrame, path: str, by: str = "threshold") -> None:
    """Raw games in text files by threshold, or by bucket, separated by an empty line; a game at a bound that two buckets share is in both."""
    games.select(by, F.concat("raw", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary as CSV with a header; summaries have a row for each file."""
    summary.write.mode("overwrite").option("header", True).csv(path)


def write_table(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as Parquet, partitioned by a column of few values if given."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def write_kept_list(games: DataFrame, path: str, columns: list[str]) -> None:
    """Columns of the kept games as CSV with a header: evs with two decimals, density with four."""
    shown = {"evs": F.format_string("%.2f", "evs"), "density": F.format_string("%.4f", "density")}
    games.select(*[shown[c].alias(c) if c in shown else c for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def upsert(new: DataFrame, path: str, key: str) -> DataFrame:
    """The keyed table at ``path`` with the rows of ``new`` in place of those with their keys; returns it."""
    return KeyedTable(new.sparkSession, path, key).put(new)


def append_hashes(accepted: DataFrame, path: str, batch: int) -> None:
    """Accepted rows of the status machine (fp, gid, evs, and what else names their source) added to the state table as a batch.

    A batch that is written again takes the place of its first attempt, so a retry doubles nothing.
    """
    kept = accepted.where("status in ('NEW GAME', 'UPGRADE', 'VERSION')").drop("status")
    kept.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def error_log(failed: DataFrame, reason: str) -> DataFrame:
    """(file, game_no, event, site, date, reason, snippet) of games that could not be used; the snippet is one line of 140 characters at most."""
    tag = lambda t: F.regexp_extract("raw", rf'\[{t}\s+"([^"]*)"\]', 1).alias(t.lower())
    snippet = F.substring(F.regexp_replace("raw", r"\n", " "), 1, 140)
    return failed.select("file", "game_no", tag("Event"), tag("Site"), tag("Date"), F.lit(reason).alias("reason"), snippet.alias("snippet"))


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes (path, content) below ``folder``, a folder all executors share, and returns (path, bytes). A repeated task overwrites its own files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                target = os.path.join(folder, os.path.basename(name))
                part = f"{target}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, target)
            yield pd.DataFrame({"path": b["path"], "bytes": b["content"].map(len)})

    return images.select("path", "content").mapInPandas(run, "path string, bytes long")
