"""Operators against small models and values worked out by hand."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import chess, scoring as S, text as X
from lectern.operators import corpus, games, index, search
from lectern.plans import catalogue
from lectern.sources import markup, pgn


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_perft():
    p = chess.Position.parse(chess.START)
    assert [chess.perft(p, d) for d in (1, 2, 3)] == [20, 400, 8902]
    assert chess.perft(chess.Position.parse("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1"), 2) == 2039
    assert chess.perft(chess.Position.parse("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1"), 3) == 2812


def test_component_scores(spark):
    r = one(
        spark,
        S.structure(F.lit(7), F.lit(40), F.lit(True)), S.structure(F.lit(3), F.lit(20), F.lit(False)),
        S.annotations(F.lit(0.2), F.lit(110), F.lit(0.0)), S.annotations(F.lit(0.5), F.lit(500), F.lit(10.0)),
        S.humanness(F.lit(2), F.lit(True), F.lit(1985), F.lit(60)),
        X.noise_penalty(F.array(F.lit("Stockfish says +1.23 depth 20")), F.lit(40), F.lit(5), F.lit(0.0)),
        X.vocabulary_score(F.lit("plan plan move"), {"plan": 5}),
    )
    assert [round(x, 6) for x in r] == [20, 8, 19, 45, 18, 3.0, 100]


def test_captions(spark):
    r = one(spark, *[X.clean_caption(F.lit(t)) for t in ("12... Nf6 $15 good", "White plays (9... Qd6 $15) well {note}", "10. Qe1 11. e4 12. f5 wins")])
    assert list(r) == ["good", "White plays well", "[moves... ] wins"]


@pytest.mark.parametrize("cp,nag", [(201, 18), (200, 16), (101, 16), (100, 14), (51, 14), (50, 11), (-50, 11), (-51, 15), (-101, 17), (-201, 19)])
def test_position_nag(spark, cp, nag):
    assert one(spark, S.position_nag(F.lit(cp), F.lit(False)))[0] == nag


def test_evaluation_chain(spark):
    rows = [("w", 0, "-", 20, None), ("w", 1, "white", -40, None), ("x", 0, "-", 100, None), ("x", 1, "white", -10, None), ("b", 0, "-", -50, None), ("b", 1, "black", 30, None), ("m", 0, "-", None, 3), ("m", 1, "white", None, -2)]
    out = games.evaluation_chain(spark.createDataFrame(rows, "g string, n int, side string, cp int, mate int"), "g", "n").where("n = 1")
    got = {r.g: (round(r["drop"], 2), r.move_nag, r.position_nag) for r in out.collect()}
    assert got == {"w": (0.6, 2, 11), "x": (1.1, 4, 11), "b": (0.8, 4, 11), "m": (1999.98, 4, 19)}


def test_game_goldens(spark):
    rows = spark.createDataFrame([(catalogue.GAME_ONE,)], "raw string")
    seen = games.scored(rows).first()
    assert seen.fingerprint == "863d0bd6a23cef779b8d4071c40f26a67f7be8e47a8ce6ddd84d4ffbfb5881e0"
    assert seen.game_id == "b5e68ce9d1a99d0b89a6e224797ceff6"
    assert (seen.plies, seen.words, seen.variation_plies, round(seen.density, 6), round(seen.evs, 6)) == (6, 17, 1, 0.166667, 65.039394)
    assert round(games.scored(rows, observed=False).first().evs, 6) == 70.304394


def test_no_moves(spark):
    g = games.scored(spark.createDataFrame([('[Event "x"]\n\n*',), (None,), ("",)], "raw string")).collect()
    assert {r.game_id for r in g} == {"d41d8cd98f00b204e9800998ecf8427e"}
    assert all(r.evs is None for r in g)


def sequential(new, state):
    """The status machine row by row."""
    prints, best, out = {f for f, _, _ in state}, {}, {}
    for _, g, e in state:
        best[g] = max(e, best.get(g, e))
    for i, f, g, e in sorted(new):
        if f in prints:
            out[i] = "DUPLICATE"
        elif e > 0:
            out[i] = "NEW GAME" if g not in best else "UPGRADE" if e > best[g] else "VERSION"
            best[g] = max(e, best.get(g, e))
            prints.add(f)
        else:
            out[i] = "REJECTED"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_status_machine(spark, seed, monkeypatch):
    monkeypatch.setattr(corpus, "SPAN", (7, 1000)[seed % 2])
    r = random.Random(seed)
    new = [(i, f"f{r.randrange(9)}", f"g{r.randrange(4)}", float(r.choice([0, 10, 20, 30]))) for i in range(40)]
    state = [(f"f{r.randrange(9)}", f"g{r.randrange(4)}", float(r.choice([10, 20]))) for _ in range(3)]
    out = corpus.dedup_status(spark.createDataFrame(new, "idx int, fp string, gid string, evs double"), spark.createDataFrame(state, "fp string, gid string, evs double"))
    assert {x.idx: x.status for x in out.collect()} == sequential(new, state)


def test_status_golden_and_error(spark):
    rows = [(1, "A", "g1", 50.0), (2, "B", "g1", 60.0), (3, "A", "g1", 50.0), (4, "C", "g1", 55.0), (5, "E", "g1", 60.0), (6, "D", "g2", 0.0), (7, "D", "g2", None), (8, None, "g2", 1.0)]
    out = corpus.dedup_status(spark.createDataFrame(rows, "idx int, fp string, gid string, evs double"), spark.createDataFrame([], "fp string, gid string, evs double"))
    assert [x.status for x in out.orderBy("idx").collect()] == ["NEW GAME", "UPGRADE", "DUPLICATE", "VERSION", "VERSION", "REJECTED", "REJECTED", "ERROR"]


def test_overlap_golden(spark):
    rows = corpus.overlap_parts(spark.createDataFrame([("x" * 1000, 40), ("abc", 0)], "text string, plies int")).orderBy("plies", "part").collect()
    assert [(r.start, r.end, r.moves) for r in rows] == [(0, 3, None), (0, 333, "1-18"), (300, 666, "19-36"), (633, 1000, "37-40")]


def test_parsers():
    assert corpus.parse_thresholds("70,80") == [70.0, 80.0] and corpus.parse_thresholds("x") == [70.0]
    assert corpus.parse_buckets(["30-40=path", "bad"]) == [(30.0, 40.0, "path")]
    assert search.query_terms("Tell me about the pawn") == ["pawn"] and search.query_terms("what is") == ["what", "is"]
    assert search.agent_terms("What are the key ideas of isolated pawn?") == ["isolated", "pawn"]
    assert search.agent_terms("Explain the Sicilian c-file, c++ & e4?") == ["sicilian", "c-file", "c", "e4"]
    assert search.agent_terms("What is the?") == [] == search.agent_terms("- ?")


def test_words_with_special_characters(spark, tmp_path):
    d = spark.createDataFrame([(1, "the Sicilian, c-file (king side) e4 c++"), (2, "nothing")], "doc_id long, text string")
    assert [r.doc_id for r in search.bm25(d, ["Sicilian"]).collect()] == [1]
    assert search.bm25(d, ["c++"]).count() <= 1 and search.bm25(d, ["(king"]).count() <= 1 and search.bm25(d, ["e4?"]).count() == 0
    rated, stored = d.withColumn("quality", F.lit(0)), index.Index(spark, str(tmp_path / "i")).write(d)
    found = lambda q: [r.doc_id for r in index.concept(stored, rated, q).collect()]
    assert found("(king") == found("c++") == found("tell me about the SICILIAN") == found("side) E4") == [1] and found("e4?") == []
    passages = d.select("doc_id", F.lit("t").alias("title"), F.lit("c").alias("chapter"), F.col("text").alias("content"))
    asked = lambda q: [r.doc_id for r in index.library(stored, passages, q).collect()]
    assert asked("What is the Sicilian?") == asked("c-file!") == asked('"king side"') == [1] and asked('"side king"') == [] and asked("what is the") == []


def test_missing_path_and_empty_header(spark, tmp_path):
    from lectern.sources import pgn

    with pytest.warns(UserWarning, match="does not exist"):
        assert pgn.read(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "X.PGN").write_text('[Event ""]\n\n1. e4 *\n')
    r = pgn.read(spark, str(tmp_path / "X.PGN")).select(pgn.header(F.col("raw"), "Event").alias("e"), pgn.header(F.col("raw"), "Site").alias("s")).first()
    assert (r.e, r.s) == ("", "Unknown") and pgn.read(spark, str(tmp_path)).count() == 0


def test_fingerprint_of_unicode_space(spark):
    d = spark.createDataFrame([("a b",), ("a\u00a0\u2003b\u3000",), (" a\x1c b\x85",)], "t string")
    assert d.select(X.fingerprint(F.col("t")).alias("f")).distinct().count() == 1


TOY = [(1, "isolated queen pawn structure"), (2, "queen and pawn isolated far away text text"), (3, "isolated queen"), (4, "nothing here at all"), (5, "pawn pawn pawn")]


def test_bm25_golden(spark):
    d = spark.createDataFrame(TOY, "id int, text string")
    strict = search.bm25(d, ["isolated", "queen", "pawn"], phrase=True)
    assert {r.id: round(r.score, 6) for r in strict.collect()}[1] == -1.120442
    assert {r.id for r in strict.collect()} == {1, 2}
    both = {r.id: r.score for r in search.bm25(d, ["isolated", "pawn"]).collect()}
    assert round(both[1] * 1e6, 3) == -2.040 and round(both[2] * 1e6, 3) == -1.460
    assert [r.id for r in search.bm25(d, ["isolated", "pawn"], any_word=True).orderBy("score", "id").collect()][:2] == [1, 5]
    assert search.bm25(d, ["isolated", "pawn"]).unionByName(search.bm25(d.limit(0), ["pawn"])).count() == 2
    assert search.bm25(d, []).count() == 0


def test_noise_and_first(spark):
    rows = [(1, "Book", "One", "Same start", -2.0), (2, "Book", "Two", "Same start", -3.0), (3, "Index", "One", "x", -9.0), (4, None, "One", "x", -9.0), (5, "Book", "One", "Preface to", -9.0)]
    d = search.without_noise(spark.createDataFrame(rows, "id int, title string, chapter string, content string, score double"))
    assert [r.id for r in search.first_of_each(d, [F.col("score")]).collect()] == [2]


def test_openings(spark):
    d = spark.createDataFrame(catalogue.FENS[:3], "id int, fen string")
    assert [r.id for r in d.where(games.fits_opening(F.col("fen"), "Sicilian plans")).collect()] == [1]
    assert [r.id for r in d.where(games.fits_opening(F.col("fen"), "French")).collect()] == [2]
    assert [r.c for r in spark.createDataFrame([("bad",), (None,)], "f string").select(games.canonical(F.col("f")).alias("c")).collect()] == [None, None]


def test_html_walk():
    page = "<html><script>x('<p>')</script><div>Out<p>One <b>two</b></p><img src='a/b.png'><p></p></div><h1>H</h1></html>"
    assert markup.elements(page) == [(0, "div", "OutOne two", ""), (1, "p", "One two", ""), (2, "img", "", "a/b.png"), (3, "h1", "H", "")]
    assert markup.elements(None) == []


def test_image_path(spark):
    known = F.array(F.struct(F.lit("OEBPS/images/a.png").alias("package_path"), F.lit("/d/1.png").alias("web_path")))
    assert list(one(spark, markup.image_path(F.lit("images/a.png"), known), markup.image_path(F.lit("../x/b.png"), known))) == ["/d/1.png", "/diagrams/b.png"]


def test_epub(spark, tmp_path):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="b" href="b.html"/><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.html", "<p>first</p>")
        z.writestr("O/b.html", "<p>second</p>")
    (tmp_path / "x.epub").write_bytes(blob.getvalue())
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    rows = markup.read_epub(spark, str(tmp_path)).orderBy("chapter").collect()
    assert [(r.chapter, r.title, r.author, r.html) for r in rows] == [(0, "T", "A", "<p>first</p>"), (1, "T", "A", "<p>second</p>")]


def test_pgn_files(spark, tmp_path):
    (tmp_path / "a.pgn").write_text(catalogue.GAME_ONE + "\n\n" + catalogue.GAME_TWO + "\n")
    rows = pgn.read(spark, str(tmp_path)).orderBy("game_no").collect()
    assert [r.game_no for r in rows] == [1, 2]
    assert rows[0].raw.strip() == catalogue.GAME_ONE and rows[1].raw.strip() == catalogue.GAME_TWO


def test_sinks(spark, tmp_path):
    from lectern.sources import sinks

    d = spark.createDataFrame([(70.0, "g1"), (80.0, "g2")], "threshold double, raw string")
    sinks.write_kept(d, str(tmp_path / "kept"))
    sinks.write_chunks(d, str(tmp_path / "chunks"))
    sinks.write_summary(d, str(tmp_path / "sum"))
    sinks.write_table(d, str(tmp_path / "t"), "threshold")
    assert spark.read.text(str(tmp_path / "kept")).where("value <> ''").count() == 2
    sinks.write_chunks(d, str(tmp_path / "chunks"), d.agg(F.count("*").alias("n")))
    r = spark.read.json(str(tmp_path / "chunks" / "stats")).first()
    assert r.n == 2 and r.created_at
    sinks.write_kept(corpus.in_buckets(d.withColumnRenamed("threshold", "evs"), [(60.0, 70.0, "low"), (70.0, 90.0, "high")]), str(tmp_path / "b"), "bucket")
    assert sorted((r.bucket, r.value) for r in spark.read.text(str(tmp_path / "b")).where("value <> ''").collect()) == [("high", "g1"), ("high", "g2"), ("low", "g1")]
    assert spark.read.json(str(tmp_path / "chunks" / "chunks")).count() == spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_replay_tries_few_moves(monkeypatch):
    """A move is sought among those of its piece and square, a repeated opening is replayed once; what is illegal or ambiguous stays so."""
    tried = []
    play = chess.Position.play
    monkeypatch.setattr(chess.Position, "play", lambda self, m: tried.append(m) or play(self, m))
    pgn.after.cache_clear()
    pgn.fen.cache_clear()
    text = "Then 1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7 ends it."
    want = "r1bqk2r/1pppbppp/p1n2n2/4p3/B3P3/5N2/PPPP1PPP/RNBQ1RK1 w kq - 4 6"
    assert pgn.position_after(text) == want and len(tried) <= 40
    done = len(tried)
    assert pgn.position_after("Again " + text) == want and len(tried) == done
    p = chess.Position.parse("4k3/8/8/8/1b6/2N5/8/1N2K3 w - - 0 1")  # the knight on c3 is pinned
    assert p.san("Nd2").uci() == "b1d2" and p.san("Na3").uci() == "b1a3"
    for text in ("Nd5", "Kd2x", "O-O", "Ke3"):
        with pytest.raises(ValueError):
            p.san(text)
    with pytest.raises(ValueError):
        chess.Position.parse("4k3/8/8/8/8/2N5/8/4K1N1 w - - 0 1").san("Ne2")
