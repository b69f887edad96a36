"""The search syntax: phrases, prefixes, AND, OR, NOT, NEAR, brackets, compiled to columns over the places of words.

A query is words and quoted phrases. Next to each other they are all wanted, which binds first; then NOT, AND, OR in this order, as
whole words in capitals. ``a + b`` is the phrase of both, ``a*`` any word that begins so, and NEAR(a b, 5) wants its phrases with at
most 5 words between the first's end and the last's start, 10 if no number is given. A word in quotes has no meaning but itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

NEAR_WORDS = 10
_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([()+*,])|(\S))')


class Refused(ValueError):
    """A query that is none by the syntax."""


def folded(text: str) -> str:
    """Lower case without marks over and under letters, as the index folds its texts."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def terms_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"\w+", folded(text)))


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms, the last one the beginning of a word if ``prefix``."""

    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    """``kind`` is phrase, near, and, or, not; ``none`` matches nothing. A not has what is wanted first and what is not second."""

    kind: str
    parts: tuple[Node, ...] = ()
    phrases: tuple[Phrase, ...] = ()
    within: int = NEAR_WORDS


NONE = Node("none")


def every(*parts: Node) -> Node:
    return parts[0] if len(parts) == 1 else Node("and", parts) if parts else NONE


def some(*parts: Node) -> Node:
    return parts[0] if len(parts) == 1 else Node("or", parts) if parts else NONE


def phrase(*terms: str, prefix: bool = False) -> Node:
    return Node("phrase", phrases=(Phrase(tuple(terms), prefix),)) if terms else NONE


@dataclass
class _Reader:
    """Tokens of a query, (kind, text), and the place of the next one."""

    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def accept(self, *wanted: tuple[str, str]) -> bool:
        found = self.peek() in wanted
        self.at += found
        return found

    def need(self, *wanted: tuple[str, str]) -> None:
        if not self.accept(*wanted):
            raise Refused(f"{wanted[0][1]} expected, not {self.peek()[1] or 'the end'}")


def parsed(query: str) -> Node:
    """The tree of a query; Refused if the syntax has no reading for it. A query of nothing matches nothing."""
    r = _Reader()
    at, text = 0, query.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        quoted, word, mark, other = m.groups()
        if other:
            raise Refused(f"no meaning for {other}")
        if quoted:
            r.tokens.append(("text", quoted[1:-1].replace('""', '"')))
        else:
            r.tokens.append(("op" if word in ("AND", "OR", "NOT") else "word" if word else "mark", word or mark))
        at = m.end()
    if not r.tokens:
        return NONE
    tree = _either(r)
    if r.peek()[0] != "end":
        raise Refused(f"no meaning for {r.peek()[1]}")
    return tree


def _either(r: _Reader) -> Node:
    parts = [_all(r)]
    while r.accept(("op", "OR")):
        parts.append(_all(r))
    return some(*parts)


def _all(r: _Reader) -> Node:
    parts = [_without(r)]
    while r.accept(("op", "AND")):
        parts.append(_without(r))
    return every(*parts)


def _without(r: _Reader) -> Node:
    tree = _beside(r)
    while r.accept(("op", "NOT")):
        tree = Node("not", (tree, _beside(r)))
    return tree


def _beside(r: _Reader) -> Node:
    if r.peek() == ("mark", "("):
        r.take()
        tree = _either(r)
        r.need(("mark", ")"))
        return tree
    parts = [_group(r)]
    while r.peek()[0] in ("text", "word"):
        parts.append(_group(r))
    # what holds no letter or digit is passed over beside other words
    return every(*[p for p in parts if p != NONE])


def _group(r: _Reader) -> Node:
    if r.peek() == ("word", "NEAR") and r.peek(1) == ("mark", "("):
        r.at += 2
        found, within = [], NEAR_WORDS
        while r.peek()[0] in ("text", "word"):
            found.append(_phrase(r))
        if r.accept(("mark", ",")):
            kind, number = r.peek()
            if kind != "word" or not number.isdigit():
                raise Refused("a number of words expected")
            r.take()
            within = int(number)
        r.need(("mark", ")"))
        if not found:
            raise Refused("NEAR of nothing")
        found = [p for p in found if p.terms]
        return Node("near", phrases=tuple(found), within=within) if len(found) > 1 else phrase(*found[0].terms, prefix=found[0].prefix) if found else NONE
    if r.peek()[0] not in ("text", "word"):
        raise Refused(f"a word expected, not {r.peek()[1] or 'the end'}")
    p = _phrase(r)
    return phrase(*p.terms, prefix=p.prefix)


def _phrase(r: _Reader) -> Phrase:
    terms = terms_of(r.take()[1])
    prefix = r.accept(("mark", "*"))
    while not prefix and r.accept(("mark", "+")):
        if r.peek()[0] not in ("text", "word"):
            raise Refused("a word expected after +")
        terms += terms_of(r.take()[1])
        prefix = r.accept(("mark", "*"))
    return Phrase(terms, prefix and bool(terms))


def phrases(tree: Node) -> list[Phrase]:
    """The distinct phrases of a tree in order of their place."""
    found = list(dict.fromkeys([*tree.phrases, *[p for part in tree.parts for p in phrases(part)]]))
    return found


def possible(tree: Node, present: dict[Phrase, Column]) -> Column:
    """Whether a set of texts may hold a match, from whether it holds the words of each phrase; what is not wanted excludes nothing."""
    if tree.kind in ("phrase", "near", "and"):
        out = F.lit(True)
        for c in [*[present[p] for p in tree.phrases], *[possible(t, present) for t in tree.parts]]:
            out = out & c
        return out
    if tree.kind == "or":
        out = F.lit(False)
        for t in tree.parts:
            out = out | possible(t, present)
        return out
    return possible(tree.parts[0], present) if tree.kind == "not" else F.lit(False)


def matches(tree: Node, count: dict[Phrase, Column], places: dict[Phrase, Column]) -> tuple[Column, list[tuple[Phrase, Column]]]:
    """(whether a text matches, occurrences of each phrase that count there) from the counts and, for NEAR, the places of phrases.

    A phrase counts where the branch that it stands in matches, one that is not wanted never.
    """
    if tree.kind == "phrase":
        p = tree.phrases[0]
        return count[p] > 0, [(p, count[p])]
    if tree.kind == "near":
        found = F.arrow_udf(_clumps([len(p.terms) for p in tree.phrases], tree.within), "found boolean, counts array<long>")(F.array(*[places[p] for p in tree.phrases]))
        return found["found"], [(p, found["counts"][tree.phrases.index(p)]) for p in dict.fromkeys(tree.phrases)]
    if tree.kind == "none":
        return F.lit(False), []
    found = [matches(t, count, places) for t in tree.parts]
    if tree.kind == "or":
        out = found[0][0]
        for ok, _ in found[1:]:
            out = out | ok
        return out, [(p, F.when(ok, c).otherwise(0)) for ok, used in found for p, c in used]
    ok = found[0][0] & ~found[1][0] if tree.kind == "not" else _and([f[0] for f in found])
    return ok, [(p, F.when(ok, c).otherwise(0)) for _, used in (found[:1] if tree.kind == "not" else found) for p, c in used]


def _clumps(lengths: list[int], within: int) -> Callable[[pa.Array], pa.Array]:
    """Of an array with the places of each phrase: whether a clump has all of them, and how many places of each stand in one.

    A clump ends at a place of any phrase; a phrase of it begins there or before, with at most ``within`` words from its end. Places are searched in
    their order, so the cost is that of sorting them.
    """
    stride, reach = 1 << 34, [n + min(within, 1 << 32) for n in lengths]

    def run(column: pa.Array) -> pa.Array:
        lists = column.flatten()
        owner = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        key, kind = owner // len(lengths) * stride + np.asarray(lists.flatten()).astype(np.int64), owner % len(lengths)
        of = [np.sort(key[kind == j]) for j in range(len(lengths))]
        last = np.unique(key)
        for keys, far in zip(of, reach):
            last = last[np.searchsorted(keys, last, side="right") > np.searchsorted(keys, last - far)]
        counts = np.zeros((len(column), len(lengths)), dtype=np.int64)
        for j, (keys, far) in enumerate(zip(of, reach)):
            used = keys[np.searchsorted(last, keys + far, side="right") > np.searchsorted(last, keys)]
            counts[:, j] = np.bincount(used // stride, minlength=len(column))
        found = np.zeros(len(column), dtype=bool)
        found[last // stride] = True
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * len(lengths), pa.int32()), pa.array(counts.ravel()))
        return pa.StructArray.from_arrays([pa.array(found), listed], names=["found", "counts"])

    return run


def _and(parts: list[Column]) -> Column:
    out = parts[0]
    for c in parts[1:]:
        out = out & c
    return out
