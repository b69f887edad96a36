"""Positions in prose: FENs and move sequences with their captions, and annotation of played moves."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import chess, text as X
from .games import FEN, analysis_url, canonical, fen_after, fits_opening

#: Context around a match: caption both sides, moves before and after; positions read and shown at most. Fixed values.
CAPTION, BEFORE, AFTER, READ, SHOWN = 250, 500, 300, 5, 3
#: A numbered move in prose: a fixed pattern.
NUMBERED = r"\b(\d+)\.\s*[a-hNBRQKO]"
#: A move in prose, with its number if it has one: a fixed pattern.
MOVE_IN_PROSE = r"((?:\d{1,3}(?:\.\.\.|\.)\s*)?[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:\=[QRBN])?[\+#]?|O-O(?:-O)?)"
PLACES = T.ArrayType(T.StructType().add("kind", "string").add("at", "integer"))


@F.pandas_udf(PLACES)
def places(text: pd.Series) -> pd.Series:
    """Where FENs and numbered moves begin in a text: offsets, which no built-in function gives."""
    return text.map(lambda x: [{"kind": k, "at": m.start()} for k, p in (("fen", FEN), ("moves", NUMBERED)) for m in re.finditer(p, x or "")])


def around(text: Column, at: Column, before: int, after: int) -> Column:
    """The characters from ``before`` an offset to ``after`` it."""
    begin = F.greatest(at - before, F.lit(0))
    return F.substring(text, begin + 1, at + after - begin)


def positions(rows: DataFrame, key: str, text: str = "text", query: str = "") -> DataFrame:
    """(key, place, fen, type, caption, moves_parsed, url): up to three positions of each text.

    Matches become rows with the characters around them. Valid FENs come first, even repeated ones; then the positions that moves
    reach, once each, until five are found. The starting position never counts. With a query that names an opening,
    those with its pawns; if none has them, all. ``key`` tells texts apart; a null text has no positions.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    hits = rows.select(F.col(key), F.explode(F.transform(places(t), lambda p: F.struct(p["kind"].alias("type"), p["at"].alias("at"), around(t, p["at"], 0, 120).alias("here"), around(t, p["at"], BEFORE, AFTER).alias("moves"), around(t, p["at"], CAPTION, CAPTION).alias("caption")))).alias("h"))
    given = F.col("h.type") == "fen"
    written = F.regexp_extract("h.here", FEN, 1)
    found = hits.select(key, "h.type", "h.at", "h.caption", F.when(given, written).alias("_given"), fen_after(F.when(~given, F.col("h.moves"))).alias("_reached"))
    found = found.withColumn("fen", F.when(canonical("_given").isNotNull(), F.col("_given")).otherwise(F.col("_reached"))).where(F.col("fen").isNotNull() & (F.col("fen") != chess.START))
    clock = F.split("fen", " ")
    found = found.withColumn("moves_parsed", F.when(F.col("type") == "moves", clock[5].cast("int") - 1 + (clock[1] == "b").cast("int"))).where("type = 'fen' or moves_parsed >= 1")
    of, order = [F.col(key)], [F.col("type"), F.col("at")]
    found = found.withColumn("_again", F.row_number().over(W.partitionBy(*of, "type", "fen").orderBy("at"))).where("type = 'fen' or _again = 1")
    each = W.partitionBy(*of).orderBy(*order)
    found = found.withColumns({"_n": F.row_number().over(each), "_fens": F.count_if(F.col("type") == "fen").over(W.partitionBy(*of))})
    # the list is closed by the move that fills it, so one move is read whatever the number of FENs
    found = found.where((F.col("_n") <= READ) | (F.col("type") == "fen") | (F.col("_n") == F.col("_fens") + 1))
    found = found.withColumn("_fits", fits_opening(F.col("fen"), query))
    found = found.withColumn("_some", F.max("_fits").over(W.partitionBy(*of))).where("_fits or not _some")
    found = found.withColumn("place", F.row_number().over(each).cast("long")).where(F.col("place") <= SHOWN)
    return found.select(key, "place", "fen", "type", X.clean_caption(X.squeezed(F.col("caption"))).alias("caption"), "moves_parsed", analysis_url(F.col("fen")).alias("url"))


def moves_in(text: Column) -> Column:
    """Array of the moves in prose, without their numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit(MOVE_IN_PROSE), F.lit(1)), lambda m: F.regexp_replace(m, r"^\d+(\.\.\.|\.)\s*", ""))


def replayed_from(fen: str, moves: list[str]) -> list[str]:
    """The positions after each move from ``fen``, until the first that is not legal."""
    out, p = [], chess.Position.parse(fen)
    for m in moves:
        try:
            p = p.play(p.san(m))
        except ValueError:
            break
        out.append(p.fen())
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def replayed(fen: pd.Series, moves: pd.Series) -> pd.Series:
    """Positions after the moves of an array from a FEN; null for a malformed FEN or nulls."""

    def one(f: str | None, m) -> list[str] | None:
        try:
            return None if f is None or m is None else replayed_from(f, list(m))
        except ValueError:
            return None

    return pd.Series([one(f, m) for f, m in zip(fen, moves)])


def judged(chain: DataFrame, threshold: float = 0.3, side: str = "both") -> DataFrame:
    """Rows of an evaluation chain (side, drop, miss) that deserve a comment: a drop over ``threshold`` or a miss, by one side or both."""
    wanted = chain if side == "both" else chain.where(F.col("side") == side)
    return wanted.where((F.col("drop") > threshold) | F.col("miss"))


def better_lines(judged_rows: DataFrame, variations: DataFrame) -> DataFrame:
    """Best lines to add to judged moves (game, ply, pv): those whose first move is no variation there (game, ply, uci) yet.

    ``line`` has the best move with glyph 142 and up to five more.
    """
    best = judged_rows.where(F.size("pv") > 0).withColumn("uci", F.col("pv")[0])
    new = best.join(variations.select("game", "ply", "uci").distinct(), ["game", "ply", "uci"], "left_anti")
    return new.withColumn("nag", F.lit(142)).withColumn("line", F.slice("pv", 1, 6))
