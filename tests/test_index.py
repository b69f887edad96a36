"""The stored index against scans, fresh builds, another engine's full-text search, and brute force over windows."""

import os
import random
import re
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from lectern.operators import grammar as G, index as I, search
from lectern.sources.files import Conflict, Log

DOCS = "doc_id long, text string"
WORDS = ["pawn", "queen", "rook", "isolated", "weak", "file", "king", "side", "grünfeld", "Grunfeld", "trap", "e4", "plan"]


def random_docs(spark, seed, n, words=WORDS, most=40):
    r = random.Random(seed)
    weight = [1.0 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(r.choices(words, weight, k=r.randrange(0, most)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, DOCS)


def ranked(df):
    return {r.doc_id: round(r.score, 9) for r in df.collect()}


def leaves(plan):
    """Leaf operators of a plan that has run, through its stages."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return leaves(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return leaves(plan.plan())
    inner = [plan.children().apply(i) for i in range(plan.children().size())]
    return [x for c in inner for x in leaves(c)] if inner else [plan]


def rows_read(df):
    """Rows that the scans of ``df`` hand on."""
    df.collect()
    found = [p for p in leaves(df._jdf.queryExecution().executedPlan()) if "Scan" in p.getClass().getSimpleName() and p.metrics().contains("numOutputRows")]
    return sum(p.metrics().apply("numOutputRows").value() for p in found)


def test_ranks_as_the_scan(spark, tmp_path):
    rows, d = random_docs(spark, 1, 400)
    d = d.unionByName(spark.createDataFrame([(1000, None), (1001, "")], DOCS))
    index = I.Index(spark, str(tmp_path / "i")).write(d)
    assert index.documents == 402 and index.total == sum(len(t.split()) for _, t in rows)
    for words in (["pawn"], ["rook", "queen"], ["trap", "e4", "king"], ["grunfeld", "none"]):
        strict = G.some(G.phrase(*words), G.every(*[G.phrase(w) for w in words]))
        assert ranked(index.scored(strict)) == ranked(search.bm25(d, words, phrase=True)) or len(words) == 1
        assert ranked(index.scored(G.some(*[G.phrase(w) for w in words]))) == ranked(search.bm25(d, words, any_word=True))
    again = I.Index(spark, str(tmp_path / "i"))
    assert ranked(again.scored(G.parsed("pawn"))) == ranked(search.bm25(d, ["pawn"]))
    assert I.Index(spark, str(tmp_path / "none")).scored(G.parsed("pawn")).count() == 0
    assert I.Index(spark, str(tmp_path / "e")).write(d.limit(0)).best(G.parsed("pawn"), 3).count() == 0


def test_updates_rank_as_a_fresh_build(spark, tmp_path):
    """Adding, replacing and deleting in any order; a version read before stays what it was, and no file is changed by a later write."""
    r = random.Random(2)
    index, live, files, versions = I.Index(spark, str(tmp_path / "i")), {}, {}, []
    trees = [G.parsed(q) for q in ("pawn", "rook OR trap", "queen pawn NOT weak", '"pawn queen" OR e4')]
    for step in range(6):
        rows, d = random_docs(spark, 10 + step, r.choice([3, 40, 90]))
        shift = r.randrange(60)
        d = d.select((F.col("doc_id") + shift).alias("doc_id"), "text")
        index = index.write(d)
        live |= {i + shift: t for i, t in rows}
        if step % 2:
            gone = r.sample(sorted(live), len(live) // 4)
            index = index.delete(spark.createDataFrame([(i,) for i in [*gone, 99_999]], "doc_id long"))
            live = {i: t for i, t in live.items() if i not in gone}
        if step in (2, 5):
            fresh = I.Index(spark, str(tmp_path / f"fresh{step}")).write(spark.createDataFrame(sorted(live.items()), DOCS))
            assert (index.documents, index.total) == (fresh.documents, fresh.total)
            for tree in trees:
                assert ranked(index.scored(tree)) == ranked(fresh.scored(tree))
            listed = lambda x: {(p.term, p.doc_id, p.tf, tuple(p.positions)) for p in x.all_postings().collect()}
            assert listed(index) == listed(fresh)
        for at, mark in files.items():
            assert (os.path.getmtime(at), os.path.getsize(at)) == mark
        files |= {os.path.join(a, f): (os.path.getmtime(os.path.join(a, f)), os.path.getsize(os.path.join(a, f))) for a, _, fs in os.walk(tmp_path / "i") for f in fs if not f.endswith(".crc")}
        versions.append((Log(spark, index.path).latest()[0], ranked(index.scored(trees[0]))))
    assert len(index.segments) < 6
    for number, want in versions[:2]:
        assert ranked(I.Index(spark, index.path, number).scored(trees[0])) == want


def test_writers_at_once_lose_nothing(spark, tmp_path):
    parts = [spark.createDataFrame([(10 * k + i, f"pawn word{k}") for i in range(10)], DOCS) for k in range(3)]
    each = [threading.Thread(target=lambda p=p: I.Index(spark, str(tmp_path / "i")).write(p)) for p in parts]
    [t.start() for t in each]
    [t.join() for t in each]
    index = I.Index(spark, str(tmp_path / "i"))
    assert index.documents == 30 and len(ranked(index.scored(G.parsed("pawn")))) == 30
    log = Log(spark, str(tmp_path / "log"))
    log.commit(0, {"a": 1})
    with pytest.raises(Conflict):
        log.commit(0, {"a": 2})
    assert log.latest() == (1, {"a": 1})


def test_repeated_rows_and_clashing_columns(spark, tmp_path):
    d = spark.createDataFrame([(1, "pawn"), (1, "queen"), (2, "rook"), (2, "rook"), (None, "pawn")], DOCS).withColumns({c: F.lit("x") for c in ("zone", "words", "term", "n")})
    index = I.Index(spark, str(tmp_path / "i")).write(d)
    assert index.documents == 3 and set(ranked(index.scored(G.parsed("queen OR rook")))) == {1, 2} and not ranked(index.scored(G.parsed("pawn")))


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Documents in a few hundred zones, with common and rare words."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    rows, d = random_docs(spark, 3, 30_000, words, 25)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(I, "ZONE_BITS", 7)
        return words, I.Index(spark, str(tmp_path_factory.mktemp("large") / "i")).write(d)


def test_top_ten_by_blocks(spark, large):
    """The ten best by blocks are those of the full ranking, and most blocks of a common word are not read."""
    words, index = large
    r = random.Random(5)
    queries = ["waa", "waa OR wab", "waa wae", "wad", "wad OR wac", "wpj", "wpj OR waa"] + [r.choice([" ", " OR ", " NOT "]).join(r.sample(words[:60], r.choice([2, 3]))) for _ in range(5)]
    top = lambda df: [(x.doc_id, round(x.score, 6)) for x in df.select("doc_id", F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(10).collect()]
    for q in queries:
        assert top(index.best(G.parsed(q), 10)) == top(index.scored(G.parsed(q))), q
    even = lambda hits: hits.where("doc_id % 2 = 0")
    assert top(index.best(G.parsed("waa"), 10, even)) == top(even(index.scored(G.parsed("waa"))))
    few, every = rows_read(index.best(G.parsed("wad"), 10)), rows_read(index.scored(G.parsed("wad"), known=index.frequencies([G.Phrase(("wad",))])))
    assert every >= 230 and few <= every * 0.6


def test_ranges():
    assert I.ranges([5, 1, 2, 9, 10], 2) == [(1, 5), (9, 10)] and I.ranges([], 3) == [] and I.ranges([7], 1) == [(7, 7)] and I.ranges([1, 3, 5], 9) == [(1, 1), (3, 3), (5, 5)]


QUERIES = [
    "pawn queen", "pawn AND queen OR trap", "pawn NOT queen", "pawn NOT queen NOT rook", '"queen pawn" OR "king side"', '"isolated queen" trap', "NEAR(isolated trap, 2)", "NEAR(pawn queen rook)",
    'NEAR("pawn queen" trap, 4) OR e4', "gru*", "(pawn OR queen) AND (trap OR e4)", "pawn + queen + ro*", "Grünfeld", "king AND (side NOT (pawn OR weak))", 'pawn "?" queen', "plan OR pawn rook NOT weak",
]


def test_grammar_as_another_engine_reads_it(spark, tmp_path):
    rows, d = random_docs(spark, 8, 500, WORDS, 24)
    index = I.Index(spark, str(tmp_path / "i")).write(d)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x)")
    con.executemany("insert into t(rowid, x) values (?, ?)", rows)
    for q in QUERIES:
        want = {i: s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (q,))}
        got = ranked(index.scored(G.parsed(q)))
        assert set(got) == set(want) and want, q
        if "NEAR" not in q and "NOT" not in q:
            assert all(abs(got[i] - want[i]) < 1e-6 for i in want), q
    for q in ("(pawn", "pawn AND", "OR queen", 'NEAR(pawn, x)', "pawn )", "(pawn OR queen) trap", "a ? b", "pawn NOT", '"open'):
        with pytest.raises(sqlite3.OperationalError):
            con.execute("select rowid from t where t match ?", (q,)).fetchall()
        with pytest.raises(G.Refused):
            G.parsed(q)


def test_questions(spark, tmp_path):
    texts = [(1, "the king side is weak"), (2, "a queen trap in the Grünfeld"), (3, r"path c:\x and 100% sure"), (4, "nothing")]
    d = spark.createDataFrame(texts, DOCS)
    index = I.Index(spark, str(tmp_path / "i")).write(d)
    passages = d.select("doc_id", F.lit("t").alias("title"), F.lit("c").alias("chapter"), F.col("text").alias("content"))
    asked = lambda q: [r.doc_id for r in I.library(index, passages, q).collect()]
    assert sorted(asked('"king side" OR "queen trap"')) == [1, 2] and sorted(asked('"king side" AND "queen trap"')) == [1, 2, 3]  # no text has both, so any of the words, "and" among them
    assert asked("what is Grunfeld") == asked("GRÜNFELD") == [2] and asked('"broken') == []
    found = lambda q: [r.doc_id for r in I.concept(index, d.withColumn("quality", F.lit(0)), q).collect()]
    assert found(r"c:\x") == [3] and found("c:\\") == [3] and found("\\") == [3] and found("zzz\\") == [] and found("100%") == [3] and found("grunfeld") == [2] and found("the c-file") == []


def pieces(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[^\W]+", text)]


def test_fragments(spark, tmp_path):
    """The window is the best of all windows; its text is that of the document with hits marked."""
    r = random.Random(6)
    rows = [(i, "".join(r.choice(["pawn", "Queen", "trap", "x", "y", "zed"]) + r.choice([" ", ", ", "\n", " - "]) for _ in range(r.randrange(1, 60)))) for i in range(80)] + [(90, "(Pawn!)")]
    d = spark.createDataFrame(rows, DOCS)
    index = I.Index(spark, str(tmp_path / "i")).write(d)
    for width in (3, 8, 200):
        hits = index.scored(G.parsed("pawn OR queen OR trap"), places=True)
        got = {x.doc_id: x.snippet for x in I.with_fragments(d, hits, width).collect()}
        for i, text in rows:
            spans = pieces(text)
            kinds = {k: text[a:b].lower() for k, (a, b) in enumerate(spans) if text[a:b].lower() in ("pawn", "queen", "trap")}
            if not kinds:
                assert i not in got
                continue
            window = lambda p: [k for k in kinds if p <= k < p + width]
            first = max(kinds, key=lambda p: (len({kinds[k] for k in window(p)}), len(window(p)), -p))
            begin = max(0, min(first - (width - (max(window(first)) - first)) // 2, len(spans) - width))
            shown, at = "", spans[begin][0] if begin else 0
            for k in range(begin, min(begin + width, len(spans))):
                a, b = spans[k]
                shown += text[at:a] + (f"**{text[a:b]}**" if k in kinds else text[a:b])
                at = b
            shown = ("..." if begin else "") + shown + ("..." if begin + width < len(spans) else text[at:])
            assert got[i] == shown
            assert len({kinds[k] for k in window(begin)}) == max(len({kinds[k] for k in window(p)}) for p in range(len(spans)))


@pytest.mark.parametrize("most", [1, 30, 10**6])
def test_blocks_of_batches(monkeypatch, most):
    """Blocks of any batch hold every place of every word once, with the least length for each count."""
    import pyarrow as pa

    monkeypatch.setattr(I, "SLICE_WORDS", most)
    r = random.Random(most)
    docs = [(i // 5, i, r.choices(["a", "bé", "c", "d"], [8, 3, 2, 1], k=r.randrange(0, 12))) for i in range(60)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.string()))], names=["zone", "doc_id", "words"])
    found = [row for b in I._blocks(4)(iter([batch(docs[:33]), batch([]), batch(docs[33:])])) for row in b.to_pylist()]
    got = {(x["term"], d): (n, tf, at) for x in found for d, n, tf, at in zip(x["docs"], x["lens"], x["tfs"], x["places"])}
    want = {(w, i): (len(ws), ws.count(w), [k for k, v in enumerate(ws) if v == w]) for _, i, ws in docs for w in set(ws)}
    assert got == want and sum(x["n"] for x in found) == len(want)
    for x in found:
        assert {d // 5 for d in x["docs"]} == {x["zone"]} and x["bucket"] == I.zlib.crc32(x["term"].encode()) % 4
        assert {(b["tf"], b["len"]) for b in x["best"]} == {(t, min(n for n, u in zip(x["lens"], x["tfs"]) if u == t)) for t in x["tfs"]}


def test_postings_lie_by_bucket_and_best_weight(spark, tmp_path, monkeypatch):
    """A bucket is one file whose pages hold many blocks; a word's blocks lie from the best to the least, so a threshold skips pages."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(I, "ZONE_BITS", 3)
    monkeypatch.setattr(I, "BUCKET_WORDS", 20_000)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows, d = random_docs(spark, 9, 3000, words, 60)
    index = I.Index(spark, str(tmp_path / "i")).write(d)
    (name, s), mean = next(iter(index.segments.items())), index.mean
    assert s["buckets"] == 8
    for b in range(8):
        (file,) = glob.glob(f"{index.path}/segments/{name}/postings/bucket={b}/*.parquet")
        found = pq.read_table(file, columns=["term", "top", "best"]).to_pylist()
        assert found and found == sorted(found, key=lambda x: (x["term"], -x["top"]))
        weight = lambda x: x["tf"] * 2.2 / (x["tf"] + 1.2 * (0.25 + 0.75 * x["len"] / mean))
        assert all(abs(x["top"] - max(map(weight, x["best"]))) < 1e-12 for x in found)


def test_thresholds_after_updates(spark, tmp_path, monkeypatch):
    """``top`` is by the mean length of a segment when it was written; the best are right too when the index has another mean since."""
    monkeypatch.setattr(I, "ZONE_BITS", 2)
    index = I.Index(spark, str(tmp_path / "i"))
    for seed, most in ((31, 6), (32, 60), (33, 250)):
        _, d = random_docs(spark, seed, 300, most=most)
        index = index.write(d.select((F.col("doc_id") + 1000 * seed).alias("doc_id"), "text"))
    index = index.delete(spark.range(33_000, 33_120).withColumnRenamed("id", "doc_id"))
    top = lambda df: [(x.doc_id, round(x.score, 6)) for x in df.select("doc_id", F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(7).collect()]
    for q in ("pawn", "trap OR e4", "queen rook", "king NOT side", "(plan OR trap) AND file"):
        assert top(index.best(G.parsed(q), 7)) == top(index.scored(G.parsed(q))), q


def test_near_in_long_texts(spark, tmp_path):
    """NEAR against brute force, and in a text of thousands of places in no more than the time of their order."""
    import pyarrow as pa

    r = random.Random(12)
    for lengths, within in (([1, 1], 3), ([1, 2, 1], 0), ([2], 5), ([1, 1], 10**30)):
        rows = [[r.sample(range(80), r.randrange(0, 9)) for _ in lengths] for _ in range(60)]
        got = G._clumps(lengths, within)(pa.array(rows, pa.list_(pa.list_(pa.int32())))).to_pylist()
        for row, x in zip(rows, got):
            beside = lambda j, last, at: at <= last <= at + lengths[j] + within
            ends = [e for places in row for e in places if all(any(beside(j, e, at) for at in p) for j, p in enumerate(row))]
            assert x == {"found": bool(ends), "counts": [sum(any(beside(j, e, at) for e in ends) for at in p) for j, p in enumerate(row)]}
    assert G._clumps([1, 1], 3)(pa.array([], pa.list_(pa.list_(pa.int32())))).to_pylist() == []
    d = spark.createDataFrame([(1, "of a with b c d e f " * 20_000), (2, "of a b c d with"), (3, "with of")], DOCS)
    index = I.Index(spark, str(tmp_path / "i")).write(d)
    assert set(ranked(index.scored(G.parsed("NEAR(of with, 3)")))) == {1, 3}


def test_packed_numbers():
    """Lists of any whole numbers come back from their bytes, whole or in part, and so do their deltas."""
    import numpy as np

    r = random.Random(21)
    for _ in range(60):
        lists = [[r.choice([0, 1, -1, 63, 64, 2**31, 2**63 - 1, -(2**63), r.randrange(10**6)]) for _ in range(r.randrange(1, 6))] for _ in range(r.randrange(1, 9))]
        sizes = np.array([len(x) for x in lists])
        values, first = np.array([v for x in lists for v in x], dtype=np.int64), np.cumsum(sizes) - sizes
        packed = I._packed(values, first)
        assert (I._numbers(packed) == values).all() and (I._numbers(packed.slice(1)) == values[sizes[0] :]).all()
        assert (I._sums(I._numbers(I._packed(I._deltas(values, first), first)), sizes) == values).all()
    assert len(I._numbers(packed.slice(0, 0))) == 0


def test_numbers_and_words_are_packed(spark, tmp_path):
    """Numbers of blocks are bytes and the words of a document a line, not arrays, whose way through exchange, sort and files was most of the work; what is read back is whole."""
    import glob

    import pyarrow.parquet as pq

    rows, d = random_docs(spark, 22, 200)
    index = I.Index(spark, str(tmp_path / "i")).write(d)
    kind = lambda at: {f.name: str(f.type) for f in pq.read_schema(glob.glob(f"{index.path}/segments/*/{at}/*.parquet")[0])}
    assert {kind("postings/*")[c] for c in ("docs", "lens", "tfs", "places")} == {"binary"} and kind("docs")["words"] == "string"
    got = {(p.term, p.doc_id): (p.tf, list(p.positions)) for p in index.all_postings().collect()}
    words = {i: t.lower().replace("ü", "u").split() for i, t in rows}
    assert got == {(w, i): (ws.count(w), [k for k, v in enumerate(ws) if v == w]) for i, ws in words.items() for w in set(ws)}


def test_lines_of_words(spark):
    """A line holds the terms that scans find, for every character."""
    from lectern.functions import text as X

    known = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(" ".join(chr(c) if c % 2 else f"x{chr(c)}Y" for c in known[i : i + 256]),) for i in range(0, len(known), 256)] + [("",), (" -a- ",), ("ΟΔΟΣ Σ ΑΣΑ, İI ",)]
    plain = X.folded(F.col("text"))
    found = spark.createDataFrame(rows, "text string").select(X.terms(plain).alias("terms"), X.term_line(plain).alias("line")).withColumn("n", X.words_in("line"))
    assert found.where(F.array_join("terms", " ") != F.col("line")).isEmpty() and found.where(F.size("terms") != F.col("n")).isEmpty()
