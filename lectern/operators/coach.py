"""Annotated games: evaluations become glyphs, better lines and comments in the exported text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import chess
from ..sources import pgn
from .games import evaluation_chain

#: Glyph of a better move and the plies shown after it: fixed values.
BETTER, AFTER_BEST = 142, 5


def mark(raw: str, plies: list[int], nags: list, lines: list, comments: list) -> str:
    """Export text of a game with glyphs, better lines (UCI) and comments at these plies.

    A better line is added beside the played move unless a variation begins with its first move; it ends at its first illegal move.
    """
    root = pgn.tree(raw)
    at = {n: node for n, node in enumerate(root.line(), 1)}
    for ply, glyphs, line, comment in zip(plies, nags, lines, comments):
        node = at.get(ply)
        if node is None:
            continue
        node.nags |= {int(g) for g in glyphs}
        if comment:
            node.comment = comment
        if line is None or not len(line) or any(v.move.uci() == line[0] for v in node.parent.children):
            continue
        here = node.parent
        for n, uci in enumerate(line[: 1 + AFTER_BEST]):
            move = next((m for m in here.position.legal() if m.uci() == uci), None)
            if move is None:
                break
            child = pgn.Node(here, move, here.position.play(move))
            here.children.append(child)
            here = child
            if n == 0:
                child.nags.add(BETTER)
    return pgn.export(raw, root)


@F.pandas_udf(T.StringType())
def marked(raw: pd.Series, plies: pd.Series, nags: pd.Series, lines: pd.Series, comments: pd.Series) -> pd.Series:
    """The annotated text; null for a null or a malformed FEN tag."""

    def one(x: str | None, *marks) -> str | None:
        try:
            return None if x is None else mark(x, *([] if m is None else list(m) for m in marks))
        except ValueError:
            return None

    return pd.Series([one(*row) for row in zip(raw, plies, nags, lines, comments)], dtype=object)


def better_was(best: Column) -> Column:
    """The comment that needs no outside service."""
    return F.concat(F.lit("Better was "), best)


def annotate(games: DataFrame, evals: DataFrame, threshold: float = 0.3, side: str = "both", explanation: Column | None = None) -> DataFrame:
    """``games`` (game, raw) with ``annotated``, from ``evals`` (game, ply, cp, mate, pv; ply 0 is the start, odd plies are White's unless it has a ``side``).

    Moves of ``side`` (both, white, black) get the glyph of their position. One that drops more than ``threshold`` pawns, or misses a
    better move by 0.75, gets its own glyph, the best line of the position before and a comment: ``explanation``, a
    column over side, drop, cp and best, else the best move. Games without evaluations are exported as they are.
    """
    if "side" not in evals.columns:
        evals = evals.withColumn("side", F.when(F.col("ply") % 2 == 1, "white").otherwise("black"))
    line = F.lag("pv").over(W.partitionBy("game").orderBy("ply"))
    chain = evaluation_chain(evals.withColumn("line", line), "game", "ply").where("ply > 0").withColumn("best", F.try_element_at("line", F.lit(1)))
    if side != "both":
        chain = chain.where(F.col("side") == side)
    bad = F.coalesce((F.col("drop") > threshold) | F.col("miss"), F.lit(False))
    glyphs = F.array_compact(F.array("position_nag", F.when(bad, F.coalesce("move_nag", F.lit(2)))))
    said = F.concat(explanation if explanation is not None else better_was(F.col("best")), F.lit(" [%dia]"))
    rows = chain.select("game", F.struct("ply", glyphs.alias("nags"), F.when(bad, F.col("line")).alias("line"), F.when(bad, said).alias("comment")).alias("m"))
    marks = rows.groupBy("game").agg(F.sort_array(F.collect_list("m")).alias("_m"))  # as many as a game has moves
    out = games.join(marks, "game", "left")
    return out.withColumn("annotated", marked("raw", *[F.col("_m")[c] for c in ("ply", "nags", "line", "comment")])).drop("_m")


def toy_position(words: str) -> str:
    """A position for a request in words: a knight on d3, rooks to fork, and kings unless the request names one."""
    text = words.lower()
    placed = {"d3": "N"} if "d3" in text else {}
    if placed and "rook" in text:
        placed |= {"f2": "r", "b2": "r"}
    if "king" not in text:
        placed |= {"e1": "K", "e8": "k"}
    board = tuple(placed.get(chess.name(s), ".") for s in range(64))
    return chess.Position(board, castling="").fen()
