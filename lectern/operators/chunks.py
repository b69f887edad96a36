"""Retrieval chunks of games: metadata, breadcrumb, summary, parts with overlap, and run statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scoring as S
from ..sources import pgn
from .corpus import overlap_parts

#: Longest chunk in estimated tokens, characters of a token, dollars for a million tokens: fixed values.
MOST_TOKENS, CHARS_PER_TOKEN, COST = 1200, 3, 0.02
#: Metadata taken from a tag as it is: fixed names.
TAGS = {
    "event": "Event", "site": "Site", "date": "Date", "round": "Round", "white": "White", "black": "Black", "result": "Result", "white_elo": "WhiteElo", "black_elo": "BlackElo",
    "eco": "ECO", "opening": "Opening", "annotator": "Annotator", "game_id": "GameId", "source_version_date": "SourceVersionDate",
}


@F.pandas_udf(T.StructType().add("text", "string").add("plies", "long").add("tags", T.MapType(T.StringType(), T.StringType())))
def exported(raw: pd.Series) -> pd.DataFrame:
    """Export text, plies of the main line and tags of a game; all null for a null or a malformed FEN tag."""
    rows = []
    for x in raw:
        try:
            root = pgn.tree(x) if x is not None else None
        except ValueError:
            root = None
        rows.append((None, None, None) if root is None else (pgn.export(x, root), sum(1 for _ in root.line()), pgn.headers(x)))
    return pd.DataFrame(rows, columns=["text", "plies", "tags"]).astype({"plies": "Int64"})


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("long")


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def metadata(games: DataFrame) -> DataFrame:
    """``games`` (file, game_no, raw) with text, plies and the metadata columns; what a game lacks is null.

    Games that cannot be read keep a row with a null text.
    """
    g = games.withColumn("_e", exported("raw")).select(*games.columns, "_e.*").withColumn("source_file", F.element_at(F.split("file", "/"), -1))
    g = g.withColumns({name: F.col("tags")[tag] for name, tag in TAGS.items()}).drop("tags")
    place = F.lower(F.concat("white", "black"))
    given = lambda c, *not_: F.when((F.col(c) != "") & ~F.col(c).isin(*not_), F.col(c))
    return g.withColumns({
        "source_type": S.source_type(F.lower(F.concat_ws(" ", "event", "source_file"))),
        "game_number": F.col("game_no"),
        "course_name": F.when(F.col("event") != "", F.col("event")).otherwise(F.replace("source_file", F.lit(".pgn"), F.lit(""))),
        "chapter": given("white", "?", "Introduction"),
        "section": given("black", "?"),
        "game_role": S.game_role(place, F.col("text")),
        "has_annotations": F.contains("text", F.lit("{")),
        "has_variations": F.contains("text", F.lit("(")),
    })


def crumbs(part: Column, parts: Column, moves: Column) -> Column:
    """Breadcrumb line of a chunk; ``part`` null for a game in one chunk."""
    named = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(n + ": "), F.col(c))) for c, n in (("course_name", "Course"), ("chapter", "Chapter"), ("section", "Section"))]
    at = F.concat(F.lit("Part "), part.cast("string"), F.lit("/"), parts.cast("string"), F.coalesce(F.concat(F.lit(" (Moves "), moves, F.lit(")")), F.lit("")))
    return F.concat_ws(" ▸ ", F.concat(F.lit("Source: "), title_case(F.col("source_type"))), *named, F.concat(F.lit("Role: "), title_case(F.col("game_role"))), at)


def summary(part: Column, parts: Column, moves: Column) -> Column:
    """Summary line of a chunk: part, players unless they name a chapter, opening, event, date, result, contents."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rated = lambda side: F.concat(F.col(side), F.when(filled(f"{side}_elo"), F.concat(F.lit(" ("), F.col(f"{side}_elo"), F.lit(")"))).otherwise(""))
    real = filled("white") & filled("black") & ~F.lower("white").rlike("chapter|introduction|line")
    flags = F.concat_ws(", ", F.when(F.col("has_annotations"), "annotated"), F.when(F.col("has_variations"), "variations"))
    out = F.concat_ws(
        " | ",
        F.concat(F.lit("Part "), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit(": Moves "), moves),
        F.when(real, F.concat(F.lit("Game: "), rated("white"), F.lit(" vs "), rated("black"))),
        F.when(filled("eco") | filled("opening"), F.trim(F.concat(F.lit("Opening: "), F.coalesce("eco", F.lit("")), F.lit(" "), F.coalesce("opening", F.lit(""))))),
        F.when(filled("event") & (F.col("event") != F.col("course_name")), F.concat(F.lit("Event: "), F.col("event"))),
        F.when(filled("date"), F.concat(F.lit("Date: "), F.col("date"))),
        F.when(filled("result"), F.concat(F.lit("Result: "), F.col("result"))),
        F.when(flags != "", F.concat(F.lit("Content: "), flags)),
    )
    return F.when(out == "", "Game details not available").otherwise(out)


def chunked(games: DataFrame) -> DataFrame:
    """Chunks of ``games`` (file, game_no, raw): chunk_id, text, token_estimate, the metadata, part_num, total_parts, move_range.

    A game of 1,200 estimated tokens at most is one chunk; a longer one is cut in parts for 18 plies that overlap by a tenth.
    """
    g = metadata(games).where("text is not null").drop("file", "game_no", "raw")
    none = F.lit(None).cast("string")
    body = lambda text, *at: F.concat_ws("\n", crumbs(*at), F.lit(""), summary(*at), F.lit(""), F.lit("PGN:"), text)
    stem = F.concat(F.regexp_replace("source_file", r"\.[^.]*$", ""), F.lit("_game_"), F.col("game_number").cast("string"))
    whole = F.col("token_estimate") <= MOST_TOKENS
    g = g.withColumn("token_estimate", token_estimate(body(F.col("text"), none, none, none)))
    # one pass for both: what fits is a game without plies to the cutter, so one part
    cut = overlap_parts(g.withColumn("_plies", F.col("plies")).withColumn("plies", F.when(whole, 0).otherwise(F.col("plies"))))
    named = {"part_num": F.when(~whole, F.col("part")), "total_parts": F.when(~whole, F.col("parts")), "move_range": F.when(~whole, F.col("moves"))}
    cut = cut.withColumns(named).withColumn("chunk_id", F.concat(stem, F.coalesce(F.concat(F.lit("_part"), F.col("part_num").cast("string")), F.lit(""))))
    cut = cut.withColumn("text", body(F.col("piece"), F.col("part_num"), F.col("total_parts"), F.col("move_range"))).withColumn("token_estimate", token_estimate(F.col("text")))
    return cut.withColumn("plies", F.col("_plies")).drop("_plies", "part", "parts", "start", "end", "moves", "piece")


def statistics(games: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, games read and failed, games split, chunks, tokens and their cost."""
    read = games.agg(F.count_distinct("file").alias("files"), F.count("text").alias("games_processed"), F.count_if(F.col("text").isNull()).alias("games_failed"))
    made = chunks.agg(F.count_if(F.col("part_num") == 1).alias("games_split"), F.count("*").alias("chunks"), F.sum("token_estimate").alias("tokens"))
    both = read.unionByName(made, allowMissingColumns=True)
    out = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])
    return out.withColumn("cost", F.col("tokens") * COST / 1e6)


def first_games(games: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` games of each file."""
    return games.where(F.col("game_no") <= limit)


def first_errors(failed: DataFrame, most: int = 10) -> DataFrame:
    """A report of the first errors (file, game_no) by file and number."""
    return failed.orderBy("file", "game_no").limit(most)


def by_source_type(games: DataFrame) -> DataFrame:
    """Games of each source type, most first."""
    return games.where("text is not null").groupBy("source_type").agg(F.count("*").alias("games")).orderBy(F.desc("games"), "source_type")
