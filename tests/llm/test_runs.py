"""Periodic runs against brute force over all periods, on random strings and on whole tables, and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lectern.llm import queries, runs

DOCS = "doc_id long, text string"


def brute_runs(s, words=2, periods=2):
    """(start, length, period) of all runs of at least so many words and periods, by comparing the string with itself at every distance."""
    s, out = np.asarray(s), []
    for q in range(1, len(s) // periods + 1):
        same = np.concatenate([[False], s[q:] == s[:-q], [False]])
        step = np.flatnonzero(np.diff(same.astype(int)))
        for a, b in zip(step[::2].tolist(), step[1::2].tolist()):
            n = b - a + q
            if n >= max(words, periods * q) and not any((s[a : a + n - d] == s[a + d : a + n]).all() for d in range(1, q)):
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    """The row of the contract for one document."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    ids = {}
    found = brute_runs([ids.setdefault(w, len(ids)) for w in words], 6, 4)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-1000 * r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_maximal_runs(seed):
    r = random.Random(seed)
    for _ in range(250):
        k, n = r.choice([1, 2, 2, 3, 4, 8]), r.randrange(1, 70)
        s = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.5:
            a = r.randrange(n)
            p = r.randrange(1, n - a + 1)
            s[a:] = [s[a + (i - a) % p] for i in range(a, n)]
        got = sorted(zip(*[c.tolist() for c in runs.maximal_runs(np.array(s))]), key=lambda x: (x[0], x[2]))
        assert got == brute_runs(s), s


def test_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    got = sorted(zip(*[c.tolist() for c in runs.maximal_runs(np.array(b))]), key=lambda x: (x[0], x[2]))
    assert got == brute_runs(b) and len(got) > 200


def test_covering_set_and_vocabulary():
    """The covering set leads to every distinct square with a primitive root, and the vocabulary has each once."""
    r = random.Random(9)
    for _ in range(200):
        s = np.array([r.randrange(2) for _ in range(r.randrange(2, 50))] + [2])
        x = runs.Extensions(s)
        lo, hi, k = runs.vocabulary(x)
        got = [tuple(s[x.sa[a] : x.sa[a] + 2 * q].tolist()) for a, q in zip(lo.tolist(), k.tolist())]
        n = len(s)
        squares = {tuple(s[i : i + 2 * q].tolist()) for q in range(1, n // 2 + 1) for i in range(n - 2 * q + 1) if (s[i : i + q] == s[i + q : i + 2 * q]).all() and not any(q % d == 0 and (s[i : i + q - d] == s[i + d : i + q]).all() for d in range(1, q))}
        assert sorted(got) == sorted(squares)
        for a, b, w in zip(lo.tolist(), hi.tolist(), got):
            assert sorted(x.sa[a : b + 1].tolist()) == [i for i in range(n - len(w) + 1) if tuple(s[i : i + len(w)].tolist()) == w]


def test_no_text_with_a_run_is_left_out():
    r = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(r.randrange(1, 6)):
            k = r.choice([2, 3, 50])
            s = [r.randrange(k) for _ in range(r.randrange(40))]
            p = r.randrange(1, 12)
            texts.append(s + [100 + i % p for i in range(r.choice([0, max(6, 4 * p), max(6, 4 * p) - 1]))] + [r.randrange(k) for _ in range(r.randrange(9))])
        first = np.cumsum([0, *[len(t) for t in texts]])
        kept = runs.may_repeat(np.array(sum(texts, []), dtype=np.int64), first)
        for t, chosen in zip(texts, kept):
            assert chosen or not brute_runs(t, 6, 4)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(queries.op12_runs(spark, DATA))
    assert got == sorted((brute(r.doc_id, r.text) for r in docs), key=repr)
    assert sum(r[1] > 0 for r in got) >= 10


def test_pieces_of_any_size(spark, monkeypatch):
    """Results do not depend on how many extensions or words are taken at a time."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("n_chars < 3000").collect()
    monkeypatch.setattr(runs, "CHUNK", 7)
    for r in [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 10 == 0][:5] + docs[:2]:
        data = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        found = runs.Slice(data, np.array([0, len(data)]), [zlib.crc32(str(r.doc_id).encode())])
        want = brute(r.doc_id, r.text)
        assert len(found.runs[0]) == want[1] and runs.best(found.runs[0]) == (want[2:5] if want[1] else None) and found.collapsed() == [want[7]]


def test_edges(spark):
    marked = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (5, "a a a a a"), (None, "x y x y x y x y z"), (6, "b b b b b b c d c d c d c d"), (7, "é\u0000 é\u0000 é\u0000 é\u0000 é\u0000 é\u0000  "), (marked, None), (marked, "one two three"), (8, "the long one " * 30_000), (-9, "w " * 100_000)]
    got = rows_of(runs.periodic_runs(spark, spark.createDataFrame(rows, DOCS)))
    small = [r for r in rows if len(r[1] or "") < 1000]
    assert [r for r in got if r[0] not in (8, -9)] == sorted((brute(*r) for r in small), key=repr)
    by = {r[0]: r for r in got}
    assert by[8][:6] == (8, 1, 0, 90_000, 3, 30_000_000) and by[-9][:6] == (-9, 1, 0, 100_000, 1, 100_000_000)
    assert by[8][7] == hashlib.sha256(b"the long one").hexdigest() and by[1][7] == hashlib.sha256(b"").hexdigest()
    clash = {c: F.lit("x") for c in ("mark", "n_runs", "start", "length", "period", "runs_sha256")}
    assert rows_of(runs.periodic_runs(spark, spark.createDataFrame(rows, DOCS).withColumns(clash))) == got
    assert runs.periodic_runs(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_ties():
    assert runs.best([(0, 8, 2), (9, 4, 1), (3, 12, 3)]) == (0, 8, 2)
    assert runs.best([(0, 9, 2), (9, 14, 3), (30, 6, 1)]) == (30, 6, 1)
