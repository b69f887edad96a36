"""Games from PGN text: splitting, headers, and the move tree."""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import chess

ROSTER = ["Event", "Site", "Date", "Round", "White", "Black", "Result"]
TOKEN = re.compile(r"\{[^}]*\}|;[^\n]*|\$\d+|\(|\)|[^\s(){};$]+")
GAMES = "file string, game_no long, raw string"
#: Comments and variations of a game in prose, move numbers, and words (named) that may be moves.
PROSE = re.compile(r"\{[^}]*\}|\([^)]*\)|\d+\.+|(?P<word>(?:(?!\d+\.)[^\s{(])+)|[{(]")
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
MARKS = {"!": 1, "?": 2, "!!": 3, "??": 4, "!?": 5, "?!": 6}
WIDTH = 80


def read(spark: SparkSession, path: str, recursive: bool = False, decoding: str = "fallback") -> DataFrame:
    """(file, game_no, raw) of every game in the ``*.pgn`` files of ``path``, but for those named ``._*``.

    A single file may have its suffix in any case. A path that does not exist is warned of and has no games.
    Files are cut at ``[Event`` tags by the reader itself, so a file of any size is read in splits. Numbers follow the
    order in the file; blank blocks take no number.

    ``decoding``: ``fallback`` takes a file that is not valid UTF-8 throughout as Latin-1, ``ignore`` drops invalid bytes.
    """
    if decoding not in ("fallback", "ignore"):
        raise ValueError(f"decoding is fallback or ignore, not {decoding}")
    reader = spark.read.option("lineSep", "\n[Event ").option("recursiveFileLookup", recursive)
    if not path.lower().endswith(".pgn"):
        reader = reader.option("pathGlobFilter", "*.pgn")
    try:
        raw = reader.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no games: {path} does not exist", stacklevel=2)
        return spark.createDataFrame([], GAMES)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.where(~F.startswith("_name", F.lit("._"))).drop("_name")
    if decoding == "fallback":
        other = rows.where(~F.is_valid_utf8("value")).select("file").distinct().withColumn("_latin", F.lit(True))
        rows = rows.join(other, "file", "left").withColumn("value", F.when(F.col("_latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value")))
    else:
        rows = rows.withColumn("value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))))
    # a record after a cut begins with the tag's quoted value
    rows = rows.withColumn("value", F.when(F.startswith(F.ltrim("value"), F.lit('"')), F.concat(F.lit("[Event "), F.col("value"))).otherwise(F.col("value")))
    rows = rows.select("file", "block", "at", F.posexplode(split(F.col("value"))).alias("place", "raw"))
    # ranks within a split, after the games of the splits before: no task holds a whole file
    within = F.row_number().over(W.partitionBy("file", "block").orderBy("at", "place"))
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(counts.select("file", "block", before.alias("before")), ["file", "block"])
    return numbered.withColumn("game_no", (F.col("before") + within).cast("long")).select("file", "game_no", "raw")


def split(text: Column) -> Column:
    """Array of the games in a text: one begins at every line that starts, but for blanks, with an Event tag."""
    return F.filter(F.transform(F.split(text, r"(?m)(?=^[ \t]*\[Event )"), lambda g: F.regexp_replace(g, r"^\s+|\s+$", "")), lambda g: g != "")


def header(raw: Column, tag: str, default: str = "Unknown") -> Column:
    """A header's value without white space around it, or the default where the tag is missing; an empty value is a value."""
    pattern = rf'\[{tag}\s+"([^"]*)"\]'
    value = F.regexp_replace(F.regexp_extract(raw, pattern, 1), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.when(raw.rlike(pattern), value).otherwise(F.lit(default))


class Node:
    """A move with what follows it: the first child continues the line, others are variations."""

    __slots__ = ("parent", "move", "position", "children", "comment", "nags", "opening")

    def __init__(self, parent: Node | None, move: chess.Move | None, position: chess.Position):
        self.parent, self.move, self.position = parent, move, position
        self.children: list[Node] = []
        self.comment, self.opening, self.nags = "", "", set()

    def line(self) -> Iterator[Node]:
        """The moves after this one, without variations."""
        node = self
        while node.children:
            node = node.children[0]
            yield node

    def subtree(self) -> Iterator[Node]:
        open_ = [self]
        while open_:
            node = open_.pop()
            yield node
            open_ += node.children

    def commented(self) -> bool:
        return any(n.comment for n in self.subtree())


def tree(raw: str) -> Node:
    """The game's moves from its FEN tag or the initial position. What follows an illegal move in its line is passed over."""
    start = re.search(r'(?m)^\[FEN\s+"([^"]*)"\]', raw)
    body = re.sub(r'(?m)^\s*\[[^\]"]*"[^"]*"\]\s*$', "", raw)
    body = re.sub(r"(?m)^%.*$", "", body)
    root = node = Node(None, None, chess.Position.parse(start[1] if start else chess.START))
    lines: list[Node] = []  # where to go on after each open variation
    fresh, skip, opening = False, 0, ""  # fresh: no move of this variation yet; opening: the comment before its first
    for token in TOKEN.findall(body):
        if skip:
            skip += (token == "(") - (token == ")")
            if not skip and lines:
                node, fresh = lines.pop(), False
        elif token == "(":
            if node.parent:
                lines.append(node)
                node, fresh, opening = node.parent, True, ""
        elif token == ")":
            if lines:
                node, fresh = lines.pop(), False
        elif token[0] == "{":
            text = token[1:-1].strip()
            if fresh:
                opening = f"{opening} {text}".strip()
            else:
                node.comment = f"{node.comment} {text}".strip()
        elif token[0] == "$":
            node.nags.add(int(token[1:]))
        elif token[0] != ";" and token not in RESULTS:
            token = re.sub(r"^\d+\.*|^\.+", "", token)
            mark = re.search(r"[!?]+$", token)
            token = token.rstrip("!?")
            if token:
                try:
                    move = node.position.san(token)
                except ValueError:
                    skip = 1
                    continue
                child = Node(node, move, node.position.play(move))
                node.children.append(child)
                child.opening, opening = opening, ""
                node, fresh = child, False
            if mark and mark[0] in MARKS:
                node.nags.add(MARKS[mark[0]])
    return root


@lru_cache(1 << 14)
def after(now: chess.Position, word: str) -> chess.Position | None:
    """The position after a move, None for an illegal one; openings are shared by many texts, so a bounded number is kept."""
    try:
        return now.play(now.san(word))
    except ValueError:
        return None


@lru_cache(1 << 14)
def fen(now: chess.Position) -> str:
    """The FEN of a position, kept alike."""
    return now.fen()


def played(words: Iterable[str], most: int) -> Iterator[chess.Position]:
    """The positions after the legal moves among the words, up to ``most`` or a result."""
    now = chess.Position.parse(chess.START)
    for word in words:
        if word in RESULTS or not most:
            return
        reached = after(now, word)
        if reached is None:
            continue
        now, most = reached, most - 1
        yield now


def position_after(text: str, plies: int = 20, least: int = 2) -> str | None:
    """The FEN that the moves of a prose text reach from its first ``1.``; None without ``least`` plies."""
    begin = re.search(r"\b1\.\s*[a-hNBRQKO]", text)
    reached = list(played((m["word"] for m in PROSE.finditer(text, begin.start()) if m["word"]), plies)) if begin else []
    return fen(reached[-1]) if len(reached) >= least else None


def prune(node: Node) -> None:
    """Takes away the variations of a node that hold no comment, and those at the first move of each variation kept."""
    node.children[1:] = [v for v in node.children[1:] if v.commented()]
    for v in node.children[1:]:
        prune(v)


def parse(raw: str) -> tuple[list[str], int, str]:
    """(UCI moves of the main line, plies in its variations, final FEN).

    Variations without a comment do not count, nor do alternatives to the first move.
    """
    try:
        root = tree(raw)
    except ValueError:  # a malformed FEN tag
        return [], 0, ""
    moves = list(root.line())
    side = 0
    for node in moves:
        prune(node)
        side += sum(1 for v in node.children[1:] for _ in v.subtree())
    return [n.move.uci() for n in moves], side, (moves[-1] if moves else root).position.fen()


def headers(raw: str) -> dict[str, str]:
    """Tags of a game, the roster first and with its defaults."""
    found = dict(re.findall(r'(?m)^\s*\[(\w+)\s+"([^"]*)"\]\s*$', raw))
    roster = {t: found.pop(t, {"Date": "????.??.??", "Result": "*"}.get(t, "?")) for t in ROSTER}
    return roster | found


def export(raw: str, root: Node | None = None) -> str:
    """The game in export format: tags, then moves with numbers, comments, glyphs and variations in lines of 80 characters at most."""
    tags, root = headers(raw), root or tree(raw)
    words: list[str] = []
    bare = True  # the next move of Black needs its number
    # (node, whether its variations follow it) and brackets, last first
    open_: list[tuple[Node, bool] | str] = [(root.children[0], True)] if root.children else []
    if root.comment:
        words.append(f"{{ {root.comment} }}")
    while open_:
        item = open_.pop()
        if isinstance(item, str):
            words.append(item)
            bare = True
            continue
        node, leads = item
        if node.opening:
            words.append(f"{{ {node.opening} }}")
            bare = True
        before = node.parent.position
        if before.white or bare:
            words.append(f"{before.full}." if before.white else f"{before.full}...")
        words.append(before.notation(node.move))
        words += [f"${n}" for n in sorted(node.nags)]
        bare = bool(node.comment)
        if node.comment:
            words.append(f"{{ {node.comment} }}")
        if node.children:
            open_.append((node.children[0], True))
        if leads:
            for v in reversed(node.parent.children[1:]):
                open_ += [")", (v, False), "("]
    words.append(tags["Result"])
    lines = [""]
    for w in " ".join(words).split(" "):
        if len(lines[-1]) + len(w) + 1 > WIDTH and lines[-1]:
            lines.append("")
        lines[-1] += (" " if lines[-1] else "") + w
    return "\n".join([*[f'[{t} "{v}"]' for t, v in tags.items()], "", *lines])


def games(rows: DataFrame) -> DataFrame:
    """``rows`` (with raw) plus game_id (MD5 of the main line), plies, variation_plies, fen; Arrow batches, one pass."""
    out = "plies long, variation_plies long, game_id string, fen string"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse(x or "") for x in b["raw"]]
            yield b.assign(plies=[len(m) for m, _, _ in found], variation_plies=[v for _, v, _ in found], game_id=[hashlib.md5("".join(m).encode()).hexdigest() for m, _, _ in found], fen=[f for _, _, f in found])

    return rows.mapInPandas(run, f"{fields}, {out}")
