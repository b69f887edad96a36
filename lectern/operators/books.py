"""Books: chapters folded into chunks with the position that their moves reach, and the tables made of them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import chess, text as X
from ..sources import markup
from .fold import CHUNK_CHARS

INSTRUCTIVE = 50.0
CHUNKS = "chunk_no long, chapter long, text string, fen string, diagrams array<struct<image_path:string,fen:string,is_ocr_based:boolean>>"


def image_name(title: str, path: str) -> str:
    """Web path of a book's image: title and stem with other characters as underscores, lower case, and the extension."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, extension = name.rpartition(".")
    safe = lambda x: re.sub(r"\W+", "_", x).lower()
    return f"/diagrams/{safe(title)}_{safe(stem if stem else name)}{dot + extension if stem else ''}"


def resolve(src: str, images: list[tuple[str, str]]) -> str:
    """Web path of the first image whose path ends with the source or is its end; else /diagrams/<file name>."""
    return next((web for path, web in images if src.endswith(path) or path.endswith(src)), "/diagrams/" + src.rsplit("/", 1)[-1])


def image_paths(sources: DataFrame, images: DataFrame) -> DataFrame:
    """``sources`` (book, src and others) with ``image_path``: the web path of the first of the book's ``images`` (book, ordinal, package_path, web_path)
    whose path ends with the source or is its end, else /diagrams/<file name>. Null and empty sources have none, images without a path are none.

    Ends are compared by equality: every end of a path meets the sources, every end of a source the paths, so rows follow the lengths of both
    and not their product. Of the paths with one end only the first goes on.
    """
    ends = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.substring(F.col(c), k, F.length(c)))).alias("end")
    known = images.where("length(package_path) > 0").select(F.col("book").alias("_book"), "ordinal", "package_path", "web_path")
    asked = sources.where("length(src) > 0").select(F.col("book").alias("_book"), F.col("src").alias("_src")).distinct()
    first = lambda df: df.groupBy("_book", "end").agg(F.min("ordinal").alias("ordinal"))
    longer = asked.withColumnRenamed("_src", "end").join(first(known.select("_book", ends("package_path"), "ordinal")), ["_book", "end"]).withColumnRenamed("end", "_src")
    paths = first(known.select("_book", F.col("package_path").alias("end"), "ordinal"))
    shorter = asked.select("_book", "_src", ends("_src")).join(paths, ["_book", "end"]).select("_book", "_src", "ordinal")
    best = longer.unionByName(shorter).groupBy("_book", "_src").agg(F.min("ordinal").alias("ordinal"))
    web = best.join(known.select("_book", "ordinal", "web_path"), ["_book", "ordinal"]).select("_book", "_src", F.col("web_path").alias("_web"))
    rows = sources.join(web, (F.col("book") == F.col("_book")) & (F.col("src") == F.col("_src")), "left")
    plain = F.concat(F.lit("/diagrams/"), F.element_at(F.split("src", "/"), -1))
    return rows.withColumn("image_path", F.when(F.length("src") > 0, F.coalesce("_web", plain))).drop("_book", "_src", "_web")


def fold(chapters: Iterable[tuple[int, str]], images: list[tuple[str, str]], limit: int = CHUNK_CHARS) -> Iterator[tuple]:
    """(chunk_no, chapter, text, fen, diagrams) of a book's (chapter, html) in order.

    Tokens that are legal moves advance one board through the whole book. A chunk starts with the board's position at that
    point and closes with the block that brings it to ``limit`` characters, or with its chapter. A diagram carries the position before it.
    """
    board, moved, number = chess.Position.parse(chess.START), False, 0
    for chapter, html in chapters:
        lines: list[str] = []
        diagrams: list[dict] = []
        size, start = 0, board.fen()
        for _, tag, text, src in markup.elements(html):
            if tag == "img":
                diagrams.append({"image_path": resolve(src, images), "fen": board.fen(), "is_ocr_based": not moved})
                continue
            for token in text.split():
                token = token.strip(".,;:?!()")
                if chess.SAN.match(token) or token[:1] in ("O", "0"):
                    try:
                        board, moved = board.play(board.san(token)), True
                    except ValueError:
                        continue
            lines.append(text)
            size += len(text)
            if size >= limit:
                yield number, chapter, "\n".join(lines), start, diagrams
                lines, diagrams, size, start, number = [], [], 0, board.fen(), number + 1
        if lines or diagrams:
            yield number, chapter, "\n".join(lines), start, diagrams
            number += 1


def read_chunks(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(book, title, author, chunk_no, chapter, text, fen, diagrams) of the EPUB files of ``path``.

    Each file is folded where it is read: no shuffle, and memory for one book at a time. A broken file gives no rows.
    """
    files = markup.epub_files(spark, path, recursive)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                try:
                    chapters = markup.chapters(content, name)
                    images = [(p, image_name(chapters[0][1], p)) for p, _ in markup.images(content)] if chapters else []
                except markup.BROKEN:
                    continue
                rows = list(fold(((c[0], c[3]) for c in chapters), images))
                if rows:
                    out = pd.DataFrame(rows, columns=["chunk_no", "chapter", "text", "fen", "diagrams"])
                    yield out.assign(book=name, title=chapters[0][1], author=chapters[0][2])[["book", "title", "author", *out.columns]]

    return files.mapInPandas(run, f"book string, title string, author string, {CHUNKS}")


def read_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(book, path, content) of the images of the EPUB files of ``path``; the path is the web path that diagrams carry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                try:
                    title = next((c[1] for c in markup.chapters(content, name)), "Unknown")
                    rows = [(name, image_name(title, p), data) for p, data in markup.images(content)]
                except markup.BROKEN:
                    continue
                yield pd.DataFrame(rows, columns=["book", "path", "content"])

    return markup.epub_files(spark, path, recursive).mapInPandas(run, "book string, path string, content binary")


def fold_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The chunks of every page, each a book of one chapter."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, h in zip(b[key], b[html]) for r in fold([(0, h or "")], [])]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chapter", "text", "fen", "diagrams"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, {CHUNKS}")


def chunk_table(chunks: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``chunks`` (book, chunk_no, text, …) with book_id, chunk_id, quality_score, vocab_density, prose_ratio and is_instructional.

    Keys are hashes of the book's path and the chunk's number: the same on every run and without a global order.
    """
    score = X.vocabulary_score(F.col("text"), vocabulary)
    out = chunks.withColumn("quality_score", score).withColumns({"vocab_density": F.col("quality_score"), "prose_ratio": F.lit(0.0), "is_instructional": F.col("quality_score") > INSTRUCTIVE})
    return out.withColumns({"book_id": F.xxhash64("book"), "chunk_id": F.xxhash64("book", "chunk_no")})


def book_table(chunks: DataFrame) -> DataFrame:
    """(book_id, title, author, quality_score, processed_date) from the chunk table: the mean of a book's scores, and today."""
    return chunks.groupBy("book_id").agg(F.min("title").alias("title"), F.min("author").alias("author"), F.avg("quality_score").alias("quality_score")).withColumn("processed_date", F.current_date())


def diagram_table(chunks: DataFrame) -> DataFrame:
    """(diagram_id, chunk_id, image_path, fen, is_ocr_based) from the chunk table."""
    placed = chunks.select("chunk_id", F.posexplode("diagrams").alias("place", "d"))
    return placed.select(F.xxhash64("chunk_id", "place").alias("diagram_id"), "chunk_id", "d.*")


def with_diagrams(chunks: DataFrame, diagrams: DataFrame) -> DataFrame:
    """Each chunk with its diagrams as one array, empty if there are none."""
    held = diagrams.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("diagram_id", "image_path", "fen", "is_ocr_based"))).alias("diagrams"))
    return chunks.join(held, "chunk_id", "left").withColumn("diagrams", F.coalesce("diagrams", F.array().cast(held.schema["diagrams"].dataType)))


def first_by_position(diagrams: DataFrame, *order: str) -> DataFrame:
    """The first diagram of every FEN, with a key made from it; an aggregate that combines on the map side."""
    first = F.min_by(F.struct(*diagrams.columns), F.struct(*order))
    return diagrams.where("fen is not null").groupBy(F.md5("fen").alias("marker")).agg(first.alias("_d")).select("marker", "_d.*")


def audit(chunks: DataFrame) -> DataFrame:
    """Chunks, mean quality and instructional chunks of every book."""
    return chunks.groupBy("book_id").agg(F.count("*").alias("chunks"), F.avg("quality_score").alias("avg_quality"), F.sum(F.col("is_instructional").cast("long")).alias("instructional"))


def diagram_audit(diagrams: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book_id, diagrams, ocr): diagrams of every book, and how many of them are not tied to a move."""
    placed = diagrams.select("chunk_id", "is_ocr_based").join(chunks.select("chunk_id", "book_id"), "chunk_id")
    return placed.groupBy("book_id").agg(F.count("*").alias("diagrams"), F.count_if("is_ocr_based").alias("ocr"))


def marked_diagrams(answers: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``answers`` without the text, a row for each [DIAGRAM_ID:...] marker of it: ``marker`` and ``diagram`` of ``known`` (marker, diagram), ``missing`` where there is none."""
    marks = answers.withColumn("marker", F.explode(F.regexp_extract_all(text, F.lit(r"\[DIAGRAM_ID:([^\]]+)\]"), F.lit(1)))).drop(text)
    return marks.join(known, "marker", "left").withColumn("diagram", F.coalesce("diagram", F.lit("missing")))


def at_position(chunks: DataFrame, books: DataFrame, fen: str, limit: int = 10) -> DataFrame:
    """The best chunks at a position, with title and author; ValueError for a malformed FEN."""
    wanted = chess.Position.parse(fen).fen()
    hits = chunks.where(F.col("fen") == wanted).drop("title", "author").join(books.select("book_id", "title", "author"), "book_id")
    return hits.orderBy(F.desc("quality_score"), "chunk_id").limit(limit)


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Weights of terms from a JSON file of categories; empty if there is none or it is malformed. It is small by nature: a literal of the plan."""
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
        found = json.loads(rows[0][0]) if rows else {}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, ValueError):
            return {}
        raise
    weights: dict[str, int] = {}
    for terms in found.values():
        for term, weight in terms.items():  # a term of two categories counts for both
            weights[term] = weights.get(term, 0) + int(weight)
    return weights
