"""Tables with one row for each key, in buckets by hash of it.

A bucket is a folder of files that are never changed; a version of the table names the folder of each. Rows that are put in rewrite the buckets of
their keys, and no others; the number of buckets follows the rows, so what is written follows the change. Versions are put in place by the log,
so of writers at once none loses rows: the later one puts its rows into the other's buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .files import Log

#: Rows of a bucket from which there are twice as many buckets, and buckets of a new table.
BUCKET_ROWS, FIRST_BUCKETS = 100_000, 16


class KeyedTable:
    """The table at ``path`` with ``key``, its latest version at each call."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key, self.log = spark, path.rstrip("/"), key, Log(spark, path)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _read(self, content: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of ``content``, or of some of its buckets; None before the first version."""
        if not content:
            return None
        wanted = sorted({f for b, f in content["folders"].items() if buckets is None or int(b) in buckets})
        schema = StructType.fromJson(content["schema"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in wanted])
        return rows

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows, of the latest version or of an earlier one."""
        return self._read(self.log.read(version) if version else self.log.latest()[1])

    def find(self, keys: list) -> DataFrame | None:
        """Rows of ``keys``, from their buckets alone."""
        content = self.log.latest()[1]
        if not content:
            return None
        row = self.spark.createDataFrame([(k,) for k in keys], StructType([StructType.fromJson(content["schema"])[self.key]]))
        buckets = [r.b for r in row.select(self._bucket(content["buckets"]).alias("b")).distinct().collect()]
        return self._read(content, buckets).where(F.col(self.key).isin(keys))

    def put(self, rows: DataFrame) -> DataFrame:
        """``rows`` in place of those of their keys; of rows of one key the last in order of their values counts. Returns the table.

        Columns that only one side has are null in the other's rows. Null keys are one key.
        """
        columns = [c for c in rows.columns if c != self.key]
        rows = rows.groupBy(self.key).agg(F.max(F.struct(*columns)).alias("r")).select(self.key, "r.*") if columns else rows.distinct()
        staged = f"{self.path}/staged/{uuid.uuid4().hex[:12]}"
        rows.write.parquet(staged)
        rows = self.spark.read.schema(rows.schema).parquet(staged)

        def change(content: dict) -> dict:
            if not content:
                return self._written({"buckets": FIRST_BUCKETS, "folders": {}, "rows": {}}, rows)
            buckets = content["buckets"]
            touched = [r.b for r in rows.select(self._bucket(buckets).alias("b")).distinct().collect()]  # as many as there are buckets at most
            old = self._read(content, touched)
            kept = old.join(rows.select(F.col(self.key).alias("_key")), F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
            done = self._written(content, kept.unionByName(rows, allowMissingColumns=True))
            if sum(done["rows"].values()) > BUCKET_ROWS * done["buckets"]:
                wider = {"buckets": 2 * done["buckets"], "folders": {}, "rows": {}}
                done = self._written(wider, self._read(done))
            return done

        return self._read(self.log.update(change))

    def _written(self, content: dict, rows: DataFrame) -> dict:
        """``content`` with the buckets of ``rows`` replaced by them."""
        name, bucket = uuid.uuid4().hex[:12], self._bucket(content["buckets"])
        rows.withColumn("_bucket", bucket).repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        found = self.spark.read.schema("_bucket int").parquet(f"{self.path}/data/{name}").groupBy("_bucket").count().collect()
        fresh = {str(r["_bucket"]): r["count"] for r in found}
        folders = {b: f"data/{name}/_bucket={b}" for b in fresh}
        old = content.get("schema")
        schema = rows.schema if old is None or len(rows.schema) >= len(old["fields"]) else StructType.fromJson(old)
        return {"buckets": content["buckets"], "schema": schema.jsonValue(), "folders": {**content["folders"], **folders}, "rows": {**content["rows"], **fresh}}
