"""Every registered query of the library against its SQL, and without SQL for its shape."""

import re
from html import unescape

import pytest
from conftest import DATA

from lectern.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_sql_twin(compare, name):
    compare(catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_without_sql():
    """Queries that SQL has no twin for have a test of their content below."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"html_element_walk", "page_chunks", "text_positions"}


def test_html_walk_and_chunks(spark):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    walk = catalogue.html_element_walk(spark, DATA).collect()
    for i, html in pages.items():
        mine = sorted((r for r in walk if r.page_id == i), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert sum(r.tag == "img" for r in mine) == len(re.findall(r"<img[^>]*\ssrc=[\"'][^\"']", html))
        plain = " ".join(re.sub(r"<[^>]*>", "", unescape(re.sub(r"(?s)<(script|style).*?</\1>", "", html))).split())
        assert all(set(r.text.split()) <= set(plain.split()) or r.text in plain for r in mine if r.tag in ("h1", "h2", "h3"))
    chunks = catalogue.page_chunks(spark, DATA).collect()
    blocks = {i: [r.text for r in sorted(walk, key=lambda r: r.place) if r.page_id == i and r.tag != "img"] for i in pages}
    for i in pages:
        mine = sorted((r for r in chunks if r.book == i), key=lambda r: r.chunk_no)
        assert [t for r in mine for t in r.text.split("\n") if t] == blocks[i]
        assert all(len(r.text) - r.text.count("\n") >= 2500 for r in mine[:-1])


def test_text_positions(spark):
    from lectern.functions import chess

    rows = catalogue.text_positions(spark, DATA).collect()
    assert len({r.doc_id for r in rows}) > 50
    for r in rows:
        p = chess.Position.parse(r.fen)
        assert r.type == "moves" and r.moves_parsed == p.full - 1 + (not p.white) and 1 <= r.place <= 3


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "title", "score", "quality"]
    assert set(e.oracle_sql()) <= set(e.queries())
