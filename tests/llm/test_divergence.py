"""The divergence audit against its SQL, brute force in whole numbers, and edge cases."""

import random
import re
from collections import Counter, defaultdict

from conftest import DATA
from pyspark.sql import functions as F

from lectern.llm import divergence, queries

COLS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least, top=50):
    """The rows of the contract by definition: every kept term of every pair."""
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        tf[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        mine = sorted(s for l, s in groups if l == lang)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(tf[lang, s]) for s in mine}
        q = share(sum((tf[lang, s] for s in mine), Counter()))
        for s in mine:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if tf[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(spark, rows, least, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(tuple(r) for r in divergence.audit(spark, df, least, **more).select(*COLS).collect())


def test_sql_twin(compare):
    compare(queries.op13_divergence, queries.ORACLE["op13_divergence"])


def test_brute_force(spark):
    r = random.Random(4)
    words = ["the", "The", "THE", "of", "été", "straße", "漢字", "x1y", "don't", " ", "a\u0000b", "z"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(300):
        source = r.choice(["a", "b", "c", "ä", "", None])
        rows.append((r.choice([None, "", " ".join(r.choices(words[: r.randrange(2, len(words))], k=r.randrange(60)))]), r.choice(["en", "de", "", None]), source))
    for least, top in ((1, 50), (9, 3), (400, 50)):
        assert audited(spark, rows, least, top_terms=top) == brute(rows, least, top)


def test_corrections_join_many_sources(spark):
    """Sources without a term, with it alone, and with it together, one of them with most of the rows."""
    rows = [("common rare " * (i % 3) + f"only{chr(97 + i % 5)}", "en", f"s{i % 5}") for i in range(40)] + [("common " * 50, "en", "hot")] * 300
    assert audited(spark, rows, 2) == brute(rows, 2)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert divergence.audit(spark, spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 0), (4, "word " * 200_000, "en", "t", 0), (4, "word " * 200_000, "en", "t", 0), (None, "word", "en", None, 1)]
    clash = {c: F.lit("x") for c in ("term", "tf", "df", "docs", "total", "lead", "p", "q", "zero", "m", "n", "item", "value", "rank", "part", "a", "b", "terms", "times")}
    df = spark.createDataFrame(rows, schema).withColumns(clash)
    got = sorted(tuple(r) for r in divergence.audit(spark, df, 2).select(*COLS).collect())
    assert got == brute([(r[1], r[2], r[3]) for r in rows], 2)
    none = divergence.audit(spark, df, 30).collect()
    assert {(r.lang, r.part, r.value) for r in none} == {("en", "pair", 0)} and len(none) == 6


def test_counts_beyond_64_bits_of_product(spark):
    row = spark.createDataFrame([(10**13, 2 * 10**13, 3)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**13 + 5) // (2 * 10**13 + 15)


def test_whole_table_of_terms(spark):
    out = divergence.audit(spark, spark.read.parquet(f"{DATA}/documents.parquet"), top_terms=10**9)
    full = {(r.lang, r.source): r.n for r in out.where("part = 'term'").groupBy("lang", "source").agg(F.count("*").alias("n")).collect()}
    assert max(full.values()) > 50
