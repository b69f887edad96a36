"""Positions, evaluation chains and scored games."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

from ..functions import chess, scoring as S, text as X
from ..sources import pgn

_rank = "[rnbqkpRNBQKP1-8]{1,8}"
FEN = rf"\b((?:{_rank}/){{7}}{_rank}\s+[wb]\s+(?:K?Q?k?q?|-)\s+(?:[a-h][36]|-)\s+\d+\s+\d+)\b"
SITE = "https://lichess.org/analysis/"


def fens(text: Column) -> Column:
    """Array of FEN-like strings of a text; ``valid`` decides."""
    return F.regexp_extract_all(text, F.lit(FEN), F.lit(1))


@F.pandas_udf(StringType())
def canonical(fen: pd.Series) -> pd.Series:
    """The position's own FEN, null if it is malformed."""

    def one(x: str | None) -> str | None:
        try:
            return chess.Position.parse(x).fen() if x else None
        except ValueError:
            return None

    return fen.map(one)


@F.pandas_udf(StringType())
def fen_after(text: pd.Series) -> pd.Series:
    """The position after the moves of a text from move 1, null without two plies."""
    return text.map(lambda x: pgn.position_after(x) if x else None)


def cell(fen: Column, square: str) -> Column:
    """The piece on a square of a FEN, ``.`` for none."""
    rows = F.split(F.split(fen, " ")[0], "/")
    row = rows[8 - int(square[1])]
    for n in range(1, 9):
        row = F.replace(row, F.lit(str(n)), F.lit("." * n))
    return F.substring(row, "abcdefgh".index(square[0]) + 1, 1)


def fits_opening(fen: Column, query: str) -> Column:
    """Whether a position has the pawns of the opening that the query names; true if it names none."""
    out = F.lit(True)
    if "sicilian" in query.lower():
        out = cell(fen, "c5") == "p"
    elif "french" in query.lower():
        out = (cell(fen, "e6") == "p") & (cell(fen, "e4") == "P")
    return out


def analysis_url(fen: Column) -> Column:
    """Link to the position; slashes stay, spaces are escaped."""
    return F.concat(F.lit(SITE), F.replace(fen, F.lit(" "), F.lit(quote(" "))))


def evaluation_chain(rows: DataFrame, game: str, order: str) -> DataFrame:
    """``rows`` (side, cp, mate) of plies with the drop against the evaluation before and both glyphs.

    mate counts as 99,999 centipawns for its side. The first row of a game is its starting position.
    """
    cp = F.when(F.col("mate").isNotNull(), F.when(F.col("mate") > 0, 99_999).otherwise(-99_999)).otherwise(F.col("cp"))
    w = W.partitionBy(game).orderBy(order)
    out = rows.withColumn("cp", cp).withColumn("before", F.lag("cp").over(w))
    out = out.withColumn("drop", S.move_drop(F.col("side"), F.col("before"), F.col("cp")))
    return out.withColumns({"miss": F.coalesce(F.col("drop") > 0.75, F.lit(False)), "position_nag": S.position_nag(F.col("cp"), F.abs("cp") > 90_000)}).withColumn("move_nag", S.move_nag(F.col("drop"), F.col("miss")))


def scored(games: DataFrame, observed: bool = True) -> DataFrame:
    """``games`` (raw) with identity, features, scores, type and tier.

    ``observed`` leaves the tiered keyword hits at 0, as the published scores have it; else they count. Games without a move or
    in a language that is neither en nor es nor both en and de get no score.
    """
    g = pgn.games(games)
    raw = F.col("raw")
    g = g.withColumns({"comments": X.comments(raw), "density": X.annotation_count(raw) / F.greatest("plies", F.lit(1))})
    joined = F.array_join("comments", " ")
    heads = {t: F.regexp_extract(raw, rf'\[{t}\s+"([^"]*)"\]', 1) for t in (*pgn.ROSTER, "WhiteElo", "BlackElo", "Annotator")}
    free = F.array_join(F.filter(F.array(joined, heads["Event"], heads["Site"], heads["Annotator"]), lambda x: x != ""), " ")
    g = g.withColumns({"words": F.size(X.tokens(joined)), "langs": X.languages(free), "fingerprint": X.fingerprint(raw)})
    year = F.substring(heads["Date"], 1, 4)
    elo = (heads["WhiteElo"] != "").cast("int") + (heads["BlackElo"] != "").cast("int")
    g = g.withColumns({
        # missing roster tags count as "?"
        "structure": S.structure(F.lit(7), F.col("plies"), raw.rlike(r"\b(1-0|0-1|1/2-1/2)\b")),
        "annotations": S.annotations(F.col("density"), F.col("words"), F.lit(0.0) if observed else X.tier_weight(joined)),
        "humanness": S.humanness(elo, F.lit(True), F.when(year.rlike(r"^\d{4}$"), year).cast("int"), F.col("plies")),
        "educational": X.cue_score(joined),
        "noise": X.noise_penalty(F.col("comments"), F.col("plies"), F.col("words"), F.col("density")),
    })
    evs, kind, reason = S.score(F.col("structure") + F.col("annotations") + F.col("humanness") + F.col("educational"), F.col("noise"), F.col("words"), F.col("density"), F.col("plies"), F.col("variation_plies"))
    allowed = F.col("langs").isNull() | (F.size("langs") == 0) | F.array_contains("langs", "en") | F.array_contains("langs", "es")
    live = (F.col("plies") > 0) & allowed
    return g.withColumns({"evs": F.when(live, evs), "game_type": F.when(live, kind), "reason": F.when(live, reason)}).withColumn("tier", S.tier(F.col("evs")))
