"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, divergence, embeddings, langid, licenses, lm, minhash, packing, quality, rules, runs, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, table(spark, sf_dir, "documents"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.truncated_replies(table(spark, sf_dir, "conversations")))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(spark, table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_embeddings": op4_embeddings,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_lm": op7_lm,
    "op8_decontam": op8_decontam,
    "op9_warc": op9_warc,
    "op10_chat": op10_chat,
    "op11_rules": op11_rules,
    "op12_runs": op12_runs,
    "op13_divergence": op13_divergence,
}

ORACLE: dict[str, str] = {
    "op7_lm": lm.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_chat": chat.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
