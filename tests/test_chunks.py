"""Game trees, chunks, books and positions against values worked out by hand."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import chess
from lectern.operators import books, chunks, coach, corpus, positions, search
from lectern.plans.catalogue import GAME_ONE
from lectern.sources import markup, pgn, sinks

TAGS = "".join(f'[{t} "{v}"]\n' for t, v in zip(pgn.ROSTER, ("Long Course", "?", "2001.01.01", "1", "Chapter 2", "Plans", "*")))


def body(text):
    return pgn.export(text).split("\n\n", 1)[1].replace("\n", " ")


@pytest.mark.parametrize(
    "moves,side",
    [
        ("1. e4 e5 (1... c5 2. Nf3) 2. Nf3", 0),  # no comment
        ("1. e4 e5 (1... c5 2. Nf3 {sharp}) 2. Nf3", 2),
        ("1. e4 (1. d4 {other}) e5 2. Nf3", 0),  # alternative to the first move
        ("1. e4 e5 (1... c5 {a} 2. Nf3 (2. c3) 2... d6) 2. Nf3", 3),  # an inner one without a comment goes
        ("1. e4 e5 (1... c5 2. Nf3 d6 {b} (2... e6 3. d4) 3. d4) 2. Nf3", 6),  # but only beside the variation's first move
        ("1. e4 e5 (1... Kxe8 {bad} 2. d4) 2. Nf3", 0),  # illegal, passed over
        ("1. e4 e5 2. Ke8 Nc6 (2... d6 {x})", 0),  # what follows an illegal move is lost
    ],
)
def test_variations(moves, side):
    assert pgn.parse(TAGS + "\n" + moves)[1] == side


def test_export():
    assert body(TAGS + "\n1.e4! {a  b} e5 (1...c5 {c}) 2.Nf3 $14 *") == "1. e4 $1 { a  b } 1... e5 ( 1... c5 { c } ) 2. Nf3 $14 *"
    again = pgn.export(pgn.export(GAME_ONE))
    assert again == pgn.export(GAME_ONE) and max(map(len, again.split("\n\n", 1)[1].split("\n"))) <= 80
    assert body("1. e4") == "1. e4 *" and body("") == "*"
    assert pgn.headers("")["Date"] == "????.??.??"


@pytest.mark.parametrize(
    "fen,move,text",
    [
        ("4k3/8/8/8/8/8/4K3/R6R w - - 0 1", "a1d1", "Rad1"),
        ("4k3/8/8/R7/8/8/4K3/R7 w - - 0 1", "a1a3", "R1a3"),
        ("4k3/P7/8/8/8/8/4K3/8 w - - 0 1", "a7a8q", "a8=Q+"),
        ("6k1/5ppp/8/8/8/8/4K3/R7 w - - 0 1", "a1a8", "Ra8#"),
        ("4k3/8/8/8/8/8/8/4K2R w K - 0 1", "e1g1", "O-O"),
        ("4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 1", "e5d6", "exd6"),
    ],
)
def test_notation(fen, move, text):
    p = chess.Position.parse(fen)
    found = next(m for m in p.legal() if m.uci() == move)
    assert p.notation(found) == text and p.san(text) == found


def test_read_policies(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pgn").write_bytes(b'\n[Event "One"]\n\n1. e4 *\r\n\r\n  [Event "Two"]\n\n1. d4 *\n[Event "Three"]\n*\n')
    (tmp_path / "b.pgn").write_bytes('[Event "Café"]\n*'.encode("latin-1"))
    (tmp_path / "._c.pgn").write_text('[Event "No"]\n*')
    (tmp_path / "d.txt").write_text('[Event "No"]\n*')
    (tmp_path / "sub" / "e.pgn").write_text('[Event "Deep"]\n*')
    names = lambda df: [(r.game_no, r.n) for r in df.select("game_no", F.regexp_extract("raw", r'^\[Event "([^"]*)"', 1).alias("n"), "file").orderBy("file", "game_no").collect()]
    assert names(pgn.read(spark, str(tmp_path))) == [(1, "One"), (2, "Two"), (3, "Three"), (1, "Café")]
    assert names(pgn.read(spark, str(tmp_path), decoding="ignore"))[-1] == (1, "Caf")
    assert (1, "Deep") in names(pgn.read(spark, str(tmp_path), recursive=True))
    with pytest.raises(ValueError):
        pgn.read(spark, str(tmp_path), decoding="guess")


def test_read_splits(spark, tmp_path):
    (tmp_path / "long.pgn").write_text("\n".join(f'[Event "{i}"]\n\n1. e4 {{{"x" * (i % 90)}}} *\n' for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = pgn.read(spark, str(tmp_path)).select("game_no", F.regexp_extract("raw", r'^\[Event "([^"]*)"', 1).cast("int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, rows)) == [(i + 1, i) for i in range(3000)]


def test_chunks(spark):
    long = TAGS + "\n" + " ".join(f"{n}. {w} {{{'why ' * 120}}} {b}" for n, (w, b) in enumerate([("Nf3", "Nf6"), ("Ng1", "Ng8")] * 10, 1)) + " *"
    rows = spark.createDataFrame([("/x/big.pgn", 1, long), ("/x/big.pgn", 2, GAME_ONE), ("/x/big.pgn", 3, '[FEN "bad"]\n*'), ("/x/big.pgn", 4, None), ("/x/big.pgn", 5, "")], pgn.GAMES)
    made = chunks.chunked(rows).orderBy("chunk_id").collect()
    by = {r.chunk_id: r for r in made}
    assert set(by) == {"big_game_1_part1", "big_game_1_part2", "big_game_1_part3", "big_game_2", "big_game_5"}
    r = by["big_game_1_part3"]
    assert (r.part_num, r.total_parts, r.move_range, r.plies) == (3, 3, "37-40", 40)
    lines = r.text.split("\n")
    assert lines[0] == "Source: Course Material ▸ Course: Long Course ▸ Chapter: Chapter 2 ▸ Section: Plans ▸ Role: Key Annotated ▸ Part 3/3 (Moves 37-40)"
    assert lines[2] == "Part 3/3: Moves 37-40 | Date: 2001.01.01 | Result: * | Content: annotated"
    assert all(x.token_estimate == len(x.text) // 3 for x in made)
    text = pgn.export(long)
    size = len(text) // 3
    assert by["big_game_1_part2"].text.endswith("PGN:\n" + text[size - size // 10 : 2 * size])
    stats = chunks.statistics(chunks.metadata(rows), chunks.chunked(rows)).first()
    assert (stats.files, stats.games_processed, stats.games_failed, stats.games_split, stats.chunks) == (1, 3, 2, 1, 5)
    assert [tuple(x) for x in chunks.by_source_type(chunks.metadata(rows)).collect()] == [("course_material", 3)]
    empty = chunks.statistics(chunks.metadata(rows.limit(0)), chunks.chunked(rows.limit(0))).first()
    assert (empty.files, empty.tokens, empty.cost) == (0, 0, 0.0)


def book(title="My Book!"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        named = f"<title>{title}</title>" if title else ""
        items = '<item id="a" href="a.html"/><item id="b" href="b.html"/><item id="i" href="img/D 1.png" media-type="image/png"/>'
        z.writestr("o/p.opf", f'<package xmlns="p"><metadata>{named}</metadata><manifest>{items}</manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/a.html", '<p>Begin</p><img src="../img/D 1.png"><p>Play e4, then e5 and (Nf3).</p><img src="x/y.png">')
        z.writestr("o/b.html", "<p>" + "plan " * 600 + "Nc6</p><p>rest</p>")
        z.writestr("o/img/D 1.png", b"png")
    return out.getvalue()


def test_books(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "first.epub").write_bytes(book())
    (tmp_path / "in" / "untitled.epub").write_bytes(book(""))
    (tmp_path / "in" / "broken.epub").write_bytes(b"PK")
    (tmp_path / "in" / "._first.epub").write_bytes(book())
    rows = books.read_chunks(spark, str(tmp_path / "in"))
    held = books.chunk_table(rows, {"plan": 5}).persist()
    got = held.where("title = 'My Book!'").orderBy("chunk_no").collect()
    assert {r.title for r in held.collect()} == {"My Book!", "untitled"}
    after = "rnbqkbnr/pppp1ppp/8/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R b KQkq - 1 2"
    assert [(r.chunk_no, r.chapter, r.fen) for r in got][:2] == [(0, 0, chess.START), (1, 1, after)]
    assert got[2].fen.startswith("r1bqkbnr/pppp1ppp/2n5") and got[2].text == "rest"
    assert [(d.image_path, d.fen, d.is_ocr_based) for d in got[0].diagrams] == [("/diagrams/my_book__d_1.png", chess.START, True), ("/diagrams/y.png", after, False)]
    assert [r.is_instructional for r in got] == [False, True, False]
    b, d = books.book_table(held), books.diagram_table(held)
    assert b.count() == 2 and d.count() == 4 and d.select("diagram_id").distinct().count() == 4
    assert books.first_by_position(d, "image_path").count() == 2
    assert sorted(len(r.diagrams) for r in books.with_diagrams(held.drop("diagrams"), d).collect()) == [0, 0, 0, 0, 2, 2]
    found = books.at_position(held, b, after, 1).collect()
    assert len(found) == 1 and found[0].quality_score == 100.0
    with pytest.raises(ValueError):
        books.at_position(held, b, "nowhere")
    assert books.audit(held).count() == 2
    assert {r.path for r in books.read_images(spark, str(tmp_path / "in")).collect()} == {"/diagrams/my_book__d_1.png", "/diagrams/untitled_d_1.png"}
    (tmp_path / "out").mkdir()
    assert sinks.write_images(books.read_images(spark, str(tmp_path / "in")), str(tmp_path / "out")).count() == 2
    assert sorted(os.listdir(tmp_path / "out")) == ["my_book__d_1.png", "untitled_d_1.png"]
    held.unpersist()


def test_vocabulary(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"a": {"plan": 2}, "b": {"plan": 1, "in_the": 3}}))
    assert books.read_vocabulary(spark, str(path)) == {"plan": 3, "in_the": 3}
    path.write_text("{")
    assert books.read_vocabulary(spark, str(path)) == {} == books.read_vocabulary(spark, str(tmp_path / "none.json"))


def test_positions(spark):
    sicilian = "rnbqkbnr/pp1ppppp/8/2p5/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"
    text = f"See {sicilian} and {sicilian} and {chess.START} here. Then 1.e4 e5 2.Nf3 Nc6 ends it."
    rows = spark.createDataFrame([(1, text, "x"), (2, None, None), (3, "", "y"), (4, "1. e4 e5 2. Nf3", "z")], "id int, text string, _fen string")
    got = {}
    for r in positions.positions(rows, "id").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r)
    # the same FEN twice, then the game; the second move number gives no new position
    assert [(p.fen == sicilian, p.type) for p in got[1]] == [(True, "fen"), (True, "fen"), (False, "moves")]
    assert got[1][2].moves_parsed == 2 and got[1][0].url.endswith("%20w%20KQkq%20-%200%202")
    assert set(got) == {1, 4} and got[4][0].fen.split()[1] == "b"
    only = positions.positions(rows, "id", query="the Sicilian").where("id = 1").collect()
    assert [p.type for p in only] == ["fen", "fen"]
    assert positions.positions(rows, "id", query="french").where("id = 1").count() == 3


def test_positions_stop_at_five(spark, monkeypatch):
    many = " ".join(f"{'x' * 900} 1. {a} {b}" for a, b in [("e4", "e5"), ("d4", "d5"), ("c4", "c5"), ("Nf3", "Nf6"), ("g3", "g6"), ("b3", "b6")])
    fen = "rnbqkbnr/pp1ppppp/8/2p5/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"
    rows = spark.createDataFrame([(1, many), (2, f"{fen} " * 6 + many)], "id int, text string")
    monkeypatch.setattr(positions, "SHOWN", 99)
    got = positions.positions(rows, "id").groupBy("id", "type").count().collect()
    assert {(r.id, r.type): r["count"] for r in got} == {(1, "moves"): 5, (2, "fen"): 6, (2, "moves"): 1}


def test_position_after():
    assert pgn.position_after("After 1. e4 e5 2. Nf3 Nc6 3. Bb5 White presses.").startswith("r1bqkbnr/pppp1ppp/2n5/1B2p3/4P3/5N2")
    assert pgn.position_after("1.d4 {solid} d5 (1... Nf6) 1-0 2. c4").split()[5] == "2"
    assert pgn.position_after("12... Nf6 only") is None is pgn.position_after("1. e4 and no more")
    assert pgn.position_after("1. e4 e5 2. Nf3 Nc6", plies=3).split()[1] == "b"


def test_moves_and_lines(spark):
    r = spark.range(1).select(positions.moves_in(F.lit("First 1. e4 then 12...Nxf3+ or O-O and e8=Q")).alias("m")).first()
    assert r.m == ["e4", "Nxf3+", "O-O", "e8=Q"]
    judged = spark.createDataFrame([(1, 3, ["e2e4", "e7e5"] + ["x"] * 9), (1, 5, ["d2d4"]), (1, 7, []), (1, 9, None)], "game int, ply int, pv array<string>")
    there = spark.createDataFrame([(1, 5, "d2d4"), (1, 3, "c2c4")], "game int, ply int, uci string")
    got = positions.better_lines(judged, there).collect()
    assert [(x.ply, x.nag, len(x.line)) for x in got] == [(3, 142, 6)]


def test_keyed_sinks(spark, tmp_path):
    path = str(tmp_path / "s")
    first = sinks.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "filename string, n int"), path, "filename")
    assert first.count() == 2
    second = sinks.upsert(spark.createDataFrame([("b", 9), ("c", 3)], "filename string, n int"), path, "filename")
    assert sorted(map(tuple, second.collect())) == [("a", 1), ("b", 9), ("c", 3)]
    third = sinks.upsert(spark.createDataFrame([("a", 5)], "filename string, n int"), path, "filename")
    assert sorted(map(tuple, third.collect())) == [("a", 5), ("b", 9), ("c", 3)]
    rows = spark.createDataFrame([("f", "g", 1.0, "UPGRADE"), ("h", "i", 0.0, "REJECTED")], "fp string, gid string, evs double, status string")
    sinks.append_hashes(rows, str(tmp_path / "h"), 0)
    sinks.append_hashes(rows, str(tmp_path / "h"), 0)
    assert [r.fp for r in spark.read.parquet(str(tmp_path / "h")).collect()] == ["f"]
    assert tuple(corpus.acceptance(rows).first()) == (1, 1, 50.0) and corpus.acceptance(rows.limit(0)).first().percent == 0.0
    sinks.write_kept_list(spark.createDataFrame([("a", 71.256, 0.12345)], "file string, evs double, density double"), str(tmp_path / "k"), ["file", "evs", "density"])
    assert spark.read.text(str(tmp_path / "k")).where("value like 'a%'").first().value == "a,71.26,0.1235"
    bad = spark.createDataFrame([("f.pgn", 3, '[Event "E"]\n' + "z" * 200)], pgn.GAMES)
    log = sinks.error_log(bad, "no moves").first()
    assert (log.event, log.site, log.reason, len(log.snippet)) == ("E", "", "no moves", 140) and "\n" not in log.snippet


def test_identities(spark):
    m = F.array(*[F.lit(x) for x in ("e2e4", "e7e5", "g1f3")])
    r = spark.range(1).select(corpus.opening_key(m, 2).alias("a"), corpus.opening_key(F.slice(m, 1, 2)).alias("b"), corpus.played_key(m, F.lit("A"), F.lit("B"), F.lit("*")).alias("c")).first()
    assert r.a == r.b != r.c


def test_image_names():
    assert books.image_name("A b", "x/Pic 1.JPG") == "/diagrams/a_b_pic_1.JPG" and books.image_name("A", "noext") == "/diagrams/a_noext"
    assert markup.chapters(book(""), "/p/Some.epub")[0][1:3] == ("Some", "Unknown")


def test_annotate(spark):
    text = TAGS + "\n1. e4 e5 2. Nf3 (2. f4 {bold}) 2... Nc6 *"
    rows = spark.createDataFrame([("a", text), ("b", TAGS + "\n1. e4 *"), ("c", None)], "game string, raw string")
    evals = [("a", 0, 20, ["e2e4"]), ("a", 1, 30, ["e7e5"]), ("a", 2, 30, ["b1c3", "b8c6", "a1a8", "g8f6"]), ("a", 3, -10, ["b8c6"]), ("a", 4, 110, None)]
    evals = spark.createDataFrame([(g, p, c, None, v) for g, p, c, v in evals], "game string, ply int, cp int, mate int, pv array<string>")
    got = {r.game: r.annotated for r in coach.annotate(rows, evals).collect()}
    line = got["a"].split("\n\n", 1)[1].replace("\n", " ")
    assert line == "1. e4 $11 e5 $11 2. Nf3 $2 $11 { Better was b1c3 [%dia] } ( 2. f4 { bold } ) ( 2. Nc3 $142 Nc6 ) 2... Nc6 $4 $16 { Better was b8c6 [%dia] } *"
    assert got["b"].endswith("1. e4 *") and got["c"] is None
    white = coach.annotate(rows, evals, side="white", explanation=F.lit("Why")).where("game = 'a'").first().annotated
    assert "Why [%dia]" in white and "$16" not in white
    quiet = coach.annotate(rows, evals, threshold=0.5).where("game = 'a'").first().annotated
    assert "b1c3" not in quiet and "b8c6" in quiet


def test_toy_position():
    assert coach.toy_position("Knight fork of 2 rooks on d3") == "4k3/8/8/8/8/3N4/1r3r2/4K3 w - - 0 1"
    assert coach.toy_position("king") == "8/8/8/8/8/8/8/8 w - - 0 1"


def test_small_search_parts(spark):
    rows = spark.createDataFrame([("production_books", "Rate limit hit"), ("pgn_games", "fine"), (None, None)], "collection string, t string")
    assert tuple(search.collection_counts(rows).first()) == (1, 1)
    assert [r.f for r in rows.select(search.failed_answer(F.col("t")).alias("f")).collect()] == [True, False, None]
    assert [r.f for r in rows.select(search.preview(F.col("t"), 4).alias("f")).collect()] == ["Rate...", "fine", None]
    assert search.sampled(rows, 2, 1).count() == 2


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")
    for rows in (pages, pages.limit(0)):
        assert markup.html_elements(rows, "page_id", "html").collect() == [] == books.fold_pages(rows, "page_id", "html").collect()
    assert positions.positions(pages.limit(0), "page_id", "html").collect() == [] == chunks.chunked(spark.createDataFrame([], pgn.GAMES)).collect()
