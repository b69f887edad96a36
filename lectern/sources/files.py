"""Folders that driver and executors share, and logs of versions in them.

A log is a folder of small JSON files, one for each version of a table. A version is written aside and then put in place under its number
in one step that fails if the number is taken, so of two writers that start from one version only one goes through; the other
looks at the new version and tries again. Readers see a version whole or not at all.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, qualified path); mount points are resolved to what they stand for."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(found)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return bool(fs.exists(at))


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master without one, as in tests, gets a folder of this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/lectern-{spark.sparkContext.applicationId}"
    return _hadoop(spark, found)[1].toString().rstrip("/")


def stamp(spark: SparkSession, path: str) -> str:
    """What tells one content of a file or folder from another: names, lengths and times of its files."""
    fs, at = _hadoop(spark, path)
    files, listed = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        listed.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(listed))


class Conflict(Exception):
    """Another writer has taken the next version."""


class Log:
    """The versions of a table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> tuple[int, dict]:
        """(number, content) of the last version; 0 and {} before the first."""
        fs, folder = _hadoop(self.spark, f"{self.path}/_versions")
        if not fs.exists(folder):
            return 0, {}
        numbers = [int(n[:-5]) for f in fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit()]
        return (max(numbers), self.read(max(numbers))) if numbers else (0, {})

    def read(self, number: int) -> dict:
        fs, at = _hadoop(self.spark, f"{self.path}/_versions/{number:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, base: int, content: dict) -> int:
        """Put ``content`` in place as the version after ``base`` and return its number; Conflict if there is one."""
        jvm = self.spark.sparkContext._jvm
        fs, folder = _hadoop(self.spark, f"{self.path}/_versions")
        fs.mkdirs(folder)
        folder = fs.resolvePath(folder)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        aside = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
        target = jvm.org.apache.hadoop.fs.Path(folder, f"{base + 1:012d}.json")
        stream = fs.create(aside, True)
        stream.write(json.dumps(content, sort_keys=True).encode())
        stream.close()
        try:
            if folder.toUri().getScheme() == "file":  # a local rename would replace what is there; a link does not
                paths = jvm.java.nio.file.Paths
                try:
                    jvm.java.nio.file.Files.createLink(paths.get(target.toUri()), paths.get(aside.toUri()))
                except Exception as e:
                    if "FileAlreadyExists" in str(e):
                        raise Conflict(f"version {base + 1} exists") from None
                    raise
            elif fs.exists(target) or not fs.rename(aside, target):
                raise Conflict(f"version {base + 1} exists")
        finally:
            if fs.exists(aside):
                fs.delete(aside, False)
        return base + 1

    def update(self, change: Callable[[dict], dict | None], tries: int = 50) -> dict:
        """Commit ``change`` of the latest content, again from the then latest after a conflict; None of it changes nothing."""
        for attempt in range(tries):
            number, content = self.latest()
            wanted = change(content)
            if wanted is None:
                return content
            try:
                self.commit(number, wanted)
                return wanted
            except Conflict:
                time.sleep(min(1.0, 0.01 * 2**attempt))
        raise Conflict(f"no version after {tries} tries")
