"""The corpus pipeline: language ID, quality, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import decontam, langid, minhash, packing, quality
from lectern.llm.shared import Scratch

#: A document whose best language is less likely than this is rejected: hardly any evidence for one language over others.
LEAST_LANGUAGE = 0.3


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns under numbers, which no operator appends, and ``text`` once more to be read."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("text"))


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters and a language of some certainty; without labelled rows, those with letters.

    Null, empty and letterless texts go. Repeated rows and rows without a doc_id are judged alike, by their text; an
    empty table stays empty. Of equally likely languages the first in order counts.
    """
    model = langid.fit(docs.where(~langid.held_out("doc_id", 5, 0)).select(F.col("doc_id").alias("key"), "lang", "text"))
    if model is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = langid.predict(spark, _aside(docs), model)
    return _restored(found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)), docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the line model finds good, with a score of 0.5 or more.

    Null and empty texts are one empty line and judged as such. Without usable labels every document stays. Repeated rows
    share their fate; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    return _restored(quality.scored(spark, _aside(docs), model).where("score >= 0.5"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every near-duplicate component.

    Null and blank texts are duplicates of nothing, nor are rows without a doc_id; these stay. Of rows that repeat a doc_id and its text one stays;
    rows of one doc_id with different texts stay or go together: they stay if one of them is its component's smallest.
    An empty table stays empty.
    """
    found = Scratch(spark, "dedup").write(minhash.near_duplicates(spark, docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows")))
    out = docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("kept and rows > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return out.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; a row goes by its doc_id and text, so one without a doc_id does too.

    Null and empty texts stay, and repeated rows share their fate. An empty benchmark drops nothing.
    """
    # names that no column of the documents has
    name = "_" + "_".join(docs.columns)
    keyed = docs.withColumns({name + "_id": F.coalesce("doc_id", F.lit(-1)), name + "_null": F.col("doc_id").isNull().cast("long"), name + "_text": F.xxhash64("text")})
    keys = [c for c in keyed.columns if c not in docs.columns]
    found = decontam.contaminated(spark, keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keys)
    return keyed.join(found.select(*keys).distinct(), keys, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the documents that are left, a row for each; null and empty texts take one token, repeated rows a slot each."""
    return packing.pack(spark, docs)


STAGES = [
    ("language", language),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: Trained models and sketches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
