"""Quality rules: statistics against brute force, trees against plain recursion and their constraints, held-out accuracy, edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
from conftest import DATA
from pyspark.sql import functions as F

from lectern.llm import kernel as K, queries, rules

SF = "/root/testdata/sf0.01"


def brute(text):
    """COUNTS and whether a base rule fails, by the contract."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    again = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    counts = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again))
    return (*counts, n < 50 or 100 * len(again) > 50 * n)


def counted(texts, limit=1 << 21):
    out = []
    for _, _, data, offs in K.slices(pa.array(texts, pa.string()), limit):
        c, x = rules.statistics(data, offs)
        assert np.isfinite(x).all() and x.shape == (len(c), len(rules.FEATURES))
        out += [(*row, bool(not ok)) for row, ok in zip(c.tolist(), rules.passes(c).tolist())]
    return out


def test_statistics_of_random_texts():
    r = random.Random(5)
    alphabet = ["a", "b", "ab", "é", "漢", "#", "*", "$", "%", "&", "|", "<", ">", "\n", "\n\n", " ", " ", "\t", "\r\n", "\x0b", "\x0c", " ", " ", "\x00", "\x1c", "!"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(0, 120))) for _ in range(600)] + [None, "", "\n", " \n \n", "a", "a\na\na \na", "a b c a b c a b c " * 40]
    assert counted(texts) == [brute(t) for t in texts] == counted(texts, 50)


def test_windows_with_one_hash(monkeypatch):
    texts = ["a b c d a b c e f g", "x y z x y z", "a b c"]
    monkeypatch.setattr(rules.K, "mix", lambda h: h * np.uint64(0))
    assert counted(texts) == [brute(t) for t in texts]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_rules(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (*[r[c] for c in rules.COUNTS], r.base_failed) == brute(d.text)
        assert r.kept == (not r.base_failed and r.score >= 0.5) and 0 <= r.score <= 1


def test_verdicts_of_labels_not_seen(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = rules.rules(spark, docs, labels.where(~unseen)).join(labels.where(unseen), "doc_id").where("not base_failed")
    assert out.count() > 80 and out.where("kept = (quality = 1)").count() >= 0.97 * out.count()


def plain(m, x, node):
    """The value of a tree by recursion."""
    if m.left[node] == node:
        return m.value[node]
    return plain(m, x, m.left[node] if x[m.feature[node]] <= m.threshold[node] else m.right[node])


def test_trees_are_monotone_and_learn():
    r = np.random.default_rng(7)
    x = np.column_stack([r.random(900), r.random(900), np.round(r.random(900), 1)])
    y = (r.random(900) < 1 / (1 + np.exp(-(6 * (x[:, 1] > 0.5) - 5 * x[:, 0] + 3 * np.sin(9 * x[:, 0]))))).astype(int)
    m = rules.train(x, y, np.array([True, False, False]))
    assert (m.left == np.arange(len(m.left))).sum() > 80  # leaves
    want = [m.base + sum(plain(m, row, t) for t in m.roots) for row in x[:60]]
    assert np.allclose(m.score(x[:60]), 1 / (1 + np.exp(-np.array(want))))
    grid = np.linspace(-0.1, 1.1, 60)
    for row in x[:80]:
        z = np.tile(row, (60, 1))
        z[:, 0] = grid
        s = m.score(z)
        assert (np.diff(s) <= 1e-12).all()
    free = rules.train(x, y, np.zeros(3, dtype=bool))
    z = np.tile(x[0], (60, 1))
    z[:, 0] = grid
    assert (np.diff(free.score(z)) > 0.01).any()  # the data rise in places, so the constraint is what holds them down
    assert ((m.score(x) >= 0.5) == y).mean() > 0.8


def test_sample_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    one = rules.fit(docs, labels)
    again = rules.fit(docs.repartition(7), labels.repartition(5).unionByName(spark.createDataFrame([(None, 1), (-5, 0)], labels.schema)))
    assert (one.threshold == again.threshold).all() and (one.value == again.value).all()
    assert rules.fit(docs, labels.where("quality = 1")) is None and rules.fit(docs, labels.where("false")) is None
    conflict = labels.unionByName(labels.withColumn("quality", (1 - F.col("quality")).cast("int")))
    assert rules.fit(docs, conflict) is None


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 0), (4, "a b c " * 40, "en", "s", 0), (4, "a b c " * 40, "en", "s", 0), (None, "word " * 60, "en", None, 1), (5, long, "en", "s", 1), (6, " ".join(f"v{i}" for i in range(50)), "en", "s", 1)]
    clash = {c: F.lit("x") for c in ("n_words", "kept", "score", "quality", "x", "base_failed", "most")}
    docs, labels = spark.createDataFrame(rows, schema).withColumns(clash), spark.read.parquet(f"{SF}/labels.parquet").withColumn("x", F.lit(1))
    for learned in (labels.where("false"), labels):
        got = rules.rules(spark, docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 6").withColumns(clash)), learned).where("doc_id is null or doc_id <= 6").collect()
        want = sorted([(r[0], *brute(r[1])) for r in rows], key=repr)
        assert sorted([(r.doc_id, *[r[c] for c in rules.COUNTS], r.base_failed) for r in got], key=repr) == want
        assert all(not r.kept for r in got if r.base_failed)
        if learned.isEmpty():
            assert {r.doc_id for r in got if r.kept} == {5, 6} and all(r.score is None for r in got)
    assert rules.rules(spark, spark.createDataFrame([], schema), labels).count() == 0
