"""Scratch tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs a reread and never a recomputation of the whole job. No local checkpoint is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

PREFIX = "lectern-scratch-"


def shared_dir(spark: SparkSession) -> str:
    """Qualified URI of the shared folder, spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves a local master (tests), and any other master is refused:
    executors of a cluster don't share machine-local folders. A path without a scheme is resolved by Hadoop on the
    driver, as Spark itself would, so Python tasks and Spark's writers see the same file system.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/lectern-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


class Scratch:
    """A folder of written tables for one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{PREFIX}{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` as Parquet in the shared folder and return the reread table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"


#: Keys that hold this part of all rows, or more, are heavy: there are at most so many, and they may be broadcast.
MOST_HEAVY, LEAST_HEAVY = 100_000, 1000


def heavy_limit(rows: int) -> int:
    """Rows from which a key is heavy."""
    return max(LEAST_HEAVY, -(-rows // MOST_HEAVY))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key and in ``m`` how many rows of ``left`` have it.

    Heavy keys, at most MOST_HEAVY, are joined by broadcast where the rows of ``left`` lie; all others hold too few rows to
    burden the task that their shuffle deals them to. ``left`` may be read twice, so it should be a written table. ``m`` is dropped.
    """
    size = right.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("rows"), F.coalesce(F.max("m"), F.lit(0)).alias("most")).first()
    limit = heavy_limit(size.rows)
    if size.most < limit:
        return left.join(right.drop("m"), on, how)
    heavy = right.where(F.col("m") >= limit).drop("m")
    cold = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.where(F.col("m") < limit).drop("m"), on, how)
    return left.join(F.broadcast(heavy), on).unionByName(cold)
