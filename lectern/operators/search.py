"""Search: BM25 ranking, strict and fallback matching, noise filters, merging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from . import grammar as G

# Words that carry no meaning in a question, for the service and for the agent.
FILLERS = ["tell", "me", "about", "the", "a", "an", "what", "is"]
QUESTION_WORDS = [
    "the", "is", "what", "who", "where", "how", "when", "a", "an", "in", "on", "of", "to", "for", "with", "by", "from", "about",
    "tell", "me", "show", "give", "explain", "please", "can", "you", "does", "do", "did", "which", "are",
    "key", "concepts", "ideas", "topics", "essential", "main", "principle", "principles",
]
NOISE_TITLES = ["index", "bibliography", "contents", "about the author", "game list"]
NOISE_PREFIXES = ["index of", "index (", "bibliography", "copyright", "contents", "preface"]


def query_terms(query: str, fillers: list[str] = FILLERS) -> list[str]:
    """Words of the query without fillers; all of them if nothing is left."""
    words = query.lower().split()
    return [w for w in words if w not in fillers] or words


def sanitised(query: str) -> str:
    """A question without characters that the search syntax gives a meaning to, but for quotes and hyphens."""
    return re.sub(r'[^\w\s"-]|_', "", query)


def agent_terms(query: str) -> list[str]:
    """Lower-case words of a sanitised question without question words; may be empty. A word that a quote ends or divides is none, one that it begins is."""
    listed = (t for t in sanitised(query).lower().split() if t.startswith('"') or t.replace("-", "").isalnum())
    return [t.replace('"', "") for t in listed if t not in QUESTION_WORDS and t.replace('"', "")]


def matched(docs: DataFrame, words: list[str]) -> DataFrame:
    """``docs`` with the array ``tf`` of the words' counts, the length ``len`` and ``phrase``, the count of their sequence.

    Words are letters, digits and underscores, whatever their case and marks; null text has none of them. Any other character of a word
    stands for itself, so such a word occurs nowhere.
    """
    text, plain = X.folded(F.coalesce("text", F.lit(""))), [G.folded(k) for k in words]
    return docs.withColumns({"tf": F.array(*[X.term_count(text, [k]) for k in plain]), "len": X.term_total(text), "phrase": X.term_count(text, plain) if words else F.lit(0).cast("long")})


def bm25(docs: DataFrame, words: list[str], any_word: bool = False, phrase: bool = False) -> DataFrame:
    """Matching rows of ``docs`` (text) with ``score``, lower is better: all words must occur, or one if ``any_word``.

    With ``phrase`` the words' sequence counts as one more term and suffices. Statistics are over all rows; they are one
    row, so its join is a broadcast of fixed size. No rows match without words.
    """
    m = matched(docs, words)
    f = [F.col("tf")[i] for i in range(len(words))] + ([F.col("phrase")] if phrase else [])
    stats = m.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"), *[F.sum((x > 0).cast("long")).alias(f"_d{i}") for i, x in enumerate(f)])
    joined = m.join(F.broadcast(stats))
    score = F.lit(0.0)
    for i, x in enumerate(f):
        d = F.coalesce(F.col(f"_d{i}"), F.lit(0))
        idf = F.greatest(F.log((F.col("_n") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        score = score - idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("_avg")))
    every, some = F.forall("tf", lambda x: x > 0), F.exists("tf", lambda x: x > 0)
    keep = some if any_word else every | (F.col("phrase") > 0) if phrase else every
    return joined.where(keep & F.lit(bool(words))).withColumn("score", score).drop("_n", "_avg", *[f"_d{i}" for i in range(len(f))])


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary``, or ``fallback`` if it has no rows; decided by one look at the first row."""
    return fallback if primary.isEmpty() else primary


def like(docs: DataFrame, query: str) -> DataFrame:
    """Rows whose text contains the query, case ignored; % and _ stay wild cards, a backslash is one."""
    escaped = query.replace("\\", "\\\\")
    return docs.where(F.col("text").ilike(f"%{escaped}%"))


def without_noisy_titles(hits: DataFrame) -> DataFrame:
    """Drops hits of front and back matter by title and chapter; null ones go too."""
    keep = F.lit(True)
    for k in NOISE_TITLES:
        keep = keep & ~F.col("title").ilike(f"%{k}%") & ~F.col("chapter").ilike(f"%{k}%")
    return hits.where(keep)


def without_noisy_starts(hits: DataFrame) -> DataFrame:
    """Drops hits of front and back matter by how the content begins."""
    start = F.trim(F.lower(F.substring("content", 1, 100)))
    noisy = F.lit(False)
    for p in NOISE_PREFIXES:
        noisy = noisy | F.startswith(start, F.lit(p))
    return hits.where(~noisy)


def without_noise(hits: DataFrame) -> DataFrame:
    return without_noisy_starts(without_noisy_titles(hits))


def first_of_each(hits: DataFrame, order: list[Column]) -> DataFrame:
    """The best hit of every title and first 100 characters of content."""
    w = W.partitionBy("title", F.substring("content", 1, 100)).orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def numbered(hits: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` hits with their ``rank``; a top-k report."""
    return hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def with_total(hits: DataFrame) -> DataFrame:
    """Limited hits with ``total``, how many there are."""
    return hits.withColumn("total", F.count("*").over(W.partitionBy()))


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """(doc_id, score, lists): sum of weight / (k + rank) over ``lists`` (doc_id, rank, weight)."""
    return lists.groupBy("doc_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.count("*").alias("lists"))


def context(hits: DataFrame) -> DataFrame:
    """One row ``context`` of the ranked hits (rank, title, chapter, content); hits are a top-k report."""
    line = F.concat(F.lit("SOURCE "), F.col("rank").cast("string"), F.lit(": ["), F.col("title"), F.lit("] ("), F.coalesce("chapter", F.lit("")), F.lit(")\n"), F.col("content"))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))), lambda s: s["x"]), "\n\n").alias("context"))


def preview(text: Column, most: int = 500) -> Column:
    """The first ``most`` characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def failed_answer(answer: Column) -> Column:
    """Whether a generated answer reports a failure of its service, so that another is asked."""
    return F.lower(answer).rlike("rate limit|error")


def collection_counts(hits: DataFrame, by: str = "collection") -> DataFrame:
    """(books, games) of merged hits by the name of their collection."""
    return hits.agg(F.count_if(F.contains(by, F.lit("production"))).alias("books"), F.count_if(F.contains(by, F.lit("pgn"))).alias("games"))


def sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows at random without replacement."""
    return rows.orderBy(F.rand(seed)).limit(n)
