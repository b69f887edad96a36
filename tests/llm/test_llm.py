"""The training-data operators against brute force, exact round trips, SQL and edge cases."""

import io
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lectern.llm import chat, decontam, embeddings, graph, kernel as K, langid, licenses, lm, minhash, packing, quality, queries, shared, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(n))


def clash(df):
    """The frame with extra columns named as the operators' own."""
    extra = ["key", "score", "rep", "leader", "component", "k1", "held_out", "bucket", "block", "h", "path", "p", "body", "n", "id", "keeper", "sha", "chosen", "pair_id", "side"]
    return df.withColumns({c: F.lit("x") for c in extra if c not in df.columns})


def odd_docs(spark):
    """Nulls, blanks, repeated rows, one very long text."""
    long = "The one of many. " * 20_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 3), (4, "word", "en", "s", 4), (4, "word", "en", "s", 4), (None, "the cat sat on the mat", "en", None, 1), (5, long, "en", "s", len(long)), (6, long, None, "s", 1), (7, "12 34 !!", "en", "s", 1), (8, "Ünïcode ß 漢字", "de", "s", 2)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# words and n-grams


def test_words_match_regex():
    r = random.Random(1)
    texts = ["".join(r.choice("aB é\n\t!") for _ in range(r.randrange(0, 30))) for _ in range(300)] + [None, ""]
    seen = {}
    at = 0
    for lo, hi, data, offs in K.slices(pa.array(texts, pa.string()), 200):
        w = K.Words(data, offs)
        for d in range(hi - lo):
            mine = words_of(texts[lo + d])
            got = w.hash[w.first[d] : w.first[d + 1]]
            assert len(got) == len(mine)
            for x, h in zip(mine, got):
                assert seen.setdefault(x, h) == h
            at += 1
    assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_grams_of_short_texts():
    texts = ["a b c", "a b c d e f", "", "a b c"]
    _, _, data, offs = next(K.slices(pa.array(texts)))
    w = K.Words(data, offs)
    h, first = w.grams(5, whole_if_short=True)
    assert np.diff(first).tolist() == [1, 2, 0, 1] and h[0] == h[3]
    assert np.diff(w.grams(5)[1]).tolist() == [0, 2, 0, 0]


# 1 language


def test_language(spark):
    out = queries.op1_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.count() > 150 and held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_edges(spark):
    train = table(spark, "documents").limit(60)
    out = langid.identify(spark, clash(train.unionByName(odd_docs(spark)))).collect()
    assert len(out) == 70
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    odd = langid.identify(spark, odd_docs(spark)).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert all(r.score == 0 for r in odd if r.lang_pred == "und")
    assert langid.identify(spark, empty_docs(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(spark, odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_calibration_lowers_loss():
    r = np.random.default_rng(1)
    y = r.integers(0, 3, 400)
    z = 10 * (np.eye(3)[np.where(r.random(400) < 0.7, y, r.integers(0, 3, 400))])
    t = langid.calibrate(z, y)
    loss = lambda t: -np.log(langid._softmax(z / t)[np.arange(400), y]).mean()
    assert t > 2 and loss(t) < loss(1.0)


def test_ftrl_is_sparse():
    r = np.random.default_rng(2)
    rows = [(np.array([y, 2 + r.integers(0, 50)]), np.ones(2), int(y)) for y in r.integers(0, 2, 300)]
    w = langid.ftrl(rows, 60, 2)
    assert w[0, 0] > 0 > w[0, 1] and (w[52:] == 0).all()


# 2 packing


def brute_padding(lengths, k):
    """Least padding by trying every set of boundaries."""
    from itertools import combinations

    distinct = sorted(set(lengths))
    best = None
    for n in range(1, min(k, len(distinct)) + 1):
        for c in combinations(distinct[:-1], n - 1):
            limits = [*c, distinct[-1]]
            pad = sum(min(b for b in limits if b >= x) - x for x in lengths)
            best = pad if best is None else min(best, pad)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_boundaries(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 40) for _ in range(60)]
    edges, counts = np.unique(lengths, return_counts=True)
    limits = packing.boundaries(edges.astype(float), counts, 3)
    assert sum(min(b for b in limits if b >= x) - x for x in lengths) == brute_padding(lengths, 3)
    assert packing.boundaries(np.zeros(0), np.zeros(0), 3) == []


def plain_padding(edges, counts, buckets):
    """Least padding by the full recurrence over every split."""
    best = {(0, 0): 0}
    for k in range(1, buckets + 1):
        for i in range(1, len(edges) + 1):
            ways, pad = [], 0
            for j in range(i - 1, -1, -1):
                pad += (edges[i - 1] - edges[j]) * counts[j]
                if (k - 1, j) in best:
                    ways.append(best[k - 1, j] + pad)
            if ways:
                best[k, i] = min(ways)
    return min(best[k, len(edges)] for k in range(1, buckets + 1) if (k, len(edges)) in best)


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_of_long_texts(seed):
    r = np.random.default_rng(seed)
    edges, counts = np.unique(np.concatenate([r.integers(1, 900, 80), (10 ** r.uniform(3, 5, 60)).astype(int)]), return_counts=True)
    limits = packing.boundaries(edges.astype(float), counts, 5)
    got = sum((min(b for b in limits if b >= x) - x) * c for x, c in zip(edges.tolist(), counts.tolist()))
    assert got == plain_padding(edges.tolist(), counts.tolist(), 5)


def test_packing(spark):
    docs = table(spark, "documents")
    out = packing.pack(spark, clash(docs), 4, 2000).collect()
    want = {r.doc_id: len(words_of(r.text)) + 1 for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in out} == want
    groups = defaultdict(list)
    for r in out:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        groups[r.bucket, r.batch].append(r)
    for (bucket, batch), rows in groups.items():
        size = max(1, 2000 // rows[0].bucket_tokens)
        last = max(b for k, b in groups if k == bucket)
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and (len(rows) == size or batch == last and len(rows) < size)
    edges, counts = np.unique(list(want.values()), return_counts=True)
    assert max(want.values()) > 1024
    assert {r.bucket_tokens for r in out} == set(packing.boundaries(edges.astype(float), counts, 4))
    assert sum(r.padding for r in out) == plain_padding(edges, counts, 4)


def test_packing_edges(spark):
    out = packing.pack(spark, odd_docs(spark)).collect()
    assert len(out) == 10 and len({(r.bucket, r.batch, r.slot) for r in out}) == 10
    assert [r.n_tokens for r in out if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert packing.pack(spark, empty_docs(spark)).count() == 0
    null = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    out = packing.pack(spark, null).collect()
    assert len({(r.bucket, r.batch, r.slot) for r in out}) == 3000


# 3 licences


def brute_licenses(text):
    """Best Dice over all runs of lines for each template."""

    def grams(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        return set(zip(w, w[1:]))

    best = {}
    lines = text.split("\n")
    for name, t in licenses.TEMPLATES.items():
        b = grams(t)
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                a = grams("\n".join(lines[i : j + 1]))
                d = 2 * len(a & b) / (len(a) + len(b))
                if d >= licenses.THRESHOLD and (name not in best or (d, i - j) > (best[name][0], 1 - best[name][2])):
                    best[name] = (d, i, j - i + 1)
    return {k: v for k, v in best.items() if not any(o[0] > v[0] and o[1] < v[1] + v[2] and v[1] < o[1] + o[2] for o in best.values())}


def test_licenses(spark):
    r = random.Random(4)
    mit = licenses.TEMPLATES["MIT-text"]
    cut = mit.split()
    texts = [
        prose(r, 20) + "\nReleased under the MIT License.\n" + prose(r, 9),
        prose(r, 10) + "\n" + "\n".join(" ".join(cut[i : i + 9]) for i in range(0, len(cut), 9)) + "\n" + prose(r, 12),
        "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.",
        "\n".join(["Released under the MIT License."] * 40),
        prose(r, 60), "licensed under cc by nc 4 0\n\n LICENSED UNDER THE APACHE LICENSE VERSION 2.0",
    ]
    out = licenses.scan(spark, clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert sorted((x.first_line, x.license_id, x.dice, x.n_lines) for x in out if x.doc_id == 3) == [(i, "MIT", 1.0, 1) for i in range(40)]
    got = {(x.doc_id, x.license_id): (round(x.dice, 9), x.first_line, x.n_lines) for x in sorted(out, key=lambda x: -x.first_line)}
    want = {(i, k): (round(v[0], 9), *v[1:]) for i, t in enumerate(texts) for k, v in brute_licenses(t).items()}
    assert got == want and (1, "MIT-text") in got and (0, "MIT") in got


def brute_windows(text):
    """Best Dice over all runs of words for each template, whatever other templates hold."""
    grams = lambda w: set(zip(w, w[1:]))
    words = re.findall(r"[a-z0-9]+", text.lower())
    best = {}
    for name, t in licenses.TEMPLATES.items():
        b = grams(re.findall(r"[a-z0-9]+", t.lower()))
        if len(b & grams(words)) < 0.8 * len(b):
            continue
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 2 * len(b)) + 1):
                a = grams(words[i:j])
                best[name] = max(best.get(name, 0), 2 * len(a & b) / (len(a) + len(b)))
    return {k: v for k, v in best.items() if v >= licenses.THRESHOLD}


def test_licenses_share_lines(spark):
    r = random.Random(11)
    texts = [
        "Copyright (c) 2024 Acme. All rights reserved.",
        "Released under the MIT License, see LICENSE.",
        "x " + licenses.TEMPLATES["CC-BY-4.0"] + " " + prose(r, 30),
        prose(r, 40) + " " + licenses.TEMPLATES["ISC-text"] + " " + prose(r, 40),  # a document of one line
        prose(r, 30) + "\nsome " + licenses.TEMPLATES["MIT-text"].replace("restriction", prose(r, 1)) + " more\n" + prose(r, 9),
        "\n".join(licenses.TEMPLATES["MIT-text"].split()),  # its last two words add no new bigram
        prose(r, 5) + " released\nunder the MIT\nLicense " + prose(r, 5),
    ]
    out = licenses.scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(x.doc_id, x.license_id): (x.first_line, x.n_lines) for x in out}
    want = {(0, "proprietary"): (0, 1), (1, "MIT"): (0, 1), (2, "CC-BY-4.0"): (0, 1), (3, "ISC-text"): (0, 1), (4, "MIT-text"): (1, 1), (5, "MIT-text"): (0, texts[5].count("\n") - 1), (6, "MIT"): (0, 3)}
    assert got == want
    brute = [brute_windows(t) for t in texts]
    assert all(abs(x.dice - brute[x.doc_id][x.license_id]) < 1e-9 for x in out)
    both = "Released under the MIT License. Licensed under CC BY 4.0."
    assert {x.license_id for x in licenses.scan(spark, spark.createDataFrame([(1, both)], "doc_id long, text string")).collect()} == {"MIT", "CC-BY-4.0"}


def brute_runs(words, templates):
    """Of all runs of words of all templates the greatest, by agreeing less differing bigrams, then of those that share no word with it, and so on."""

    def grams(w):
        return set(zip(w, w[1:]))

    sets = [(n, grams(re.findall(r"[a-z0-9]+", t.lower()))) for n, t in sorted(templates.items())]
    free, out = [True] * len(words), []
    while True:
        found = []
        for k, (name, b) in enumerate(sets):
            mine = []
            for i in range(len(words)):
                for j in range(i + 2, len(words) + 1):
                    if not free[j - 1] or not free[i]:
                        break
                    a = grams(words[i:j])
                    if 2 * len(a & b) / (len(a) + len(b)) >= licenses.THRESHOLD:
                        mine.append((2 * len(a & b) / (len(a) + len(b)), i - j, -i))
            if mine:
                dice, length, i = max(mine)
                a = grams(words[-i : -i - length])
                found.append((len(a & b) - len(a - b) - len(b - a), dice, -k, -i, -i - length, name))
        if not found:
            return sorted((i, j, n, round(d, 9)) for _, d, _, i, j, n in out)
        best = max(found)
        out.append(best)
        free[best[3] : best[4]] = [False] * (best[4] - best[3])


def test_every_occurrence_of_a_license(spark):
    short = {k: licenses.TEMPLATES[k] for k in ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "GPL-2.0", "GPL-3.0", "MIT", "proprietary")}
    long = {"A-text": " ".join(f"w{i}" for i in range(14)), "B-text": " ".join(f"w{i}" for i in range(4, 12)) + " end of b"}
    table, r, seen = licenses.Templates(short | long), random.Random(31), 0
    assert [x.license_id for x in licenses.scan(spark, spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 2. x\nThis work is licensed under the GNU General Public License, version 2.")], "doc_id long, text string")).collect()] == ["GPL-2.0"] * 2
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 6)):
            part = re.findall(r"[a-z0-9]+", r.choice([*short.values(), *long.values(), *long.values()]).lower())
            if r.random() < 0.5:
                part[r.randrange(len(part))] = r.choice(["zz", "the", part[0]])
            words += part + [f"q{r.randrange(3)}"] * r.randint(0, 2)
        data, offs = K.buffers(pa.array(["\n".join(words)], pa.large_string()))
        got = sorted((s, s + n, table.names[k], round(d, 9)) for _, k, d, s, n in licenses.scan_slice(table, data, offs, licenses.THRESHOLD))
        want = brute_runs(words, short | long)
        assert got == want, words
        seen += len(got) > len({x[2] for x in got})
    assert seen > 10


def test_licenses_of_many_occurrences():
    """Time in proportion to a text of tens of thousands of occurrences."""
    text = "All rights reserved. " * 20_000 + licenses.TEMPLATES["MIT-text"] + " Released under the MIT License" * 10_000
    data, offs = K.buffers(pa.array([text.lower()], pa.large_string()))
    table, start = licenses.Templates(licenses.TEMPLATES, licenses.VARIANTS), time.time()
    names = Counter(table.names[k] for _, k, *_ in licenses.scan_slice(table, data, offs, licenses.THRESHOLD))
    assert names == {"proprietary": 20_000, "MIT-text": 1, "MIT": 10_000} and time.time() - start < 60


def test_license_texts_and_variants(spark):
    want = {
        "Licensed under the MIT License.": "MIT", "Distributed under the terms of the MIT licence, see below": "MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "available under the GNU General Public License v2.0": "GPL-2.0", "licensed under the GPLv3": "GPL-3.0", "licensed under the GNU General Public License": "GPL",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "under the 2-clause BSD license": "BSD-2-Clause",
        "licensed under the GNU Lesser General Public License version 2.1": "LGPL-2.1", "under the GNU AGPL v3": "AGPL-3.0", "under the Mozilla Public License 2.0": "MPL-2.0",
    }
    names = ["BSD-2-Clause-text", "BSD-3-Clause-text", "MPL-2.0-notice", "MPL-2.0-text", "LGPL-2.1-text", "LGPL-2.1-notice", "LGPL-3.0-text", "LGPL-3.0-notice", "AGPL-3.0-notice", "AGPL-3.0-text", "GPL-2.0-text", "GPL-2.0-notice", "GPL-3.0-text", "Unlicense", "Apache-2.0-text"]
    rows = [("a b c. " + t + " d e f", n) for t, n in want.items()] + [(" ".join(("x y\n" + licenses.TEMPLATES[n] + "\nz").split(" ")), n) for n in names]
    rows += [("We like the MIT License of the program", None), ("restricted under the law of the state", None)]
    out = licenses.scan(spark, spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    got = defaultdict(set)
    for x in out:
        got[x.doc_id].add(x.license_id)
    assert {i: n for i, (_, n) in enumerate(rows) if n} == {i: next(iter(s)) for i, s in got.items()} and all(len(s) == 1 for s in got.values())


def test_edited_license_holds_one_liners(spark):
    def edited(name):
        """The text with a word in forty replaced and a one-line notice inside."""
        w = licenses.TEMPLATES[name].split()
        w = [f"zz{i}" if i % 40 == 20 else x for i, x in enumerate(w)]
        return " ".join(w[:60]) + "\nAll rights reserved.\n" + " ".join(w[60:])

    names = ["MIT-text", "BSD-3-Clause-text", "GPL-3.0-text"]
    texts = [edited(n) for n in names] + [licenses.TEMPLATES["Apache-2.0-notice"].replace("Unless required", "Unless zz required").replace("; you", "\n; you")]
    texts += ["\n".join(("the software " + licenses.TEMPLATES["MIT-text"]).split())]
    out = licenses.scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.license_id) for x in out) == list(enumerate([*names, "Apache-2.0-notice", "MIT-text"]))
    assert all(x.dice < 1 for x in out if x.doc_id < 4)


def test_licenses_edges(spark):
    assert licenses.scan(spark, odd_docs(spark)).count() == 0
    assert licenses.scan(spark, empty_docs(spark)).count() == 0


# 4 embeddings


def test_traversal_order():
    r = np.random.default_rng(3)
    a, b = r.random((20, 7)), r.random((20, 5))
    for visits in (1, 3, 12, 35, 99):
        got = embeddings.traversal(a, b, visits)
        for i in range(20):
            want = np.argsort((a[i][:, None] + b[i][None, :]).ravel(), kind="stable")[:visits]
            assert np.allclose((a[i][:, None] + b[i][None, :]).ravel()[got[i]], (a[i][:, None] + b[i][None, :]).ravel()[want])


def brute_links(rows):
    good = [(i, np.array(v, dtype=float) / max(map(abs, v))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(int)
    for p, (i, v) in enumerate(good):
        for j, w in good[:p]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (links[i], root(i)) for i, _ in rows}


@pytest.mark.parametrize("heavy", [False, True])
def test_embeddings(spark, monkeypatch, heavy):
    """Once with every cell cut in chunks of nine members and tiles of seven."""
    if heavy:
        monkeypatch.setattr(shared, "LEAST_HEAVY", 2)
        monkeypatch.setattr(shared, "MOST_HEAVY", 10**9)
        monkeypatch.setattr(embeddings, "MEMBERS", 9)
        monkeypatch.setattr(embeddings, "QUERIES", 7)
    r = np.random.default_rng(5)
    base = r.standard_normal((150, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i % 60] + 0.18 * r.standard_normal(16)).tolist()) for i in range(200)]
    rows += [(2000 + i, base[0].tolist()) for i in range(300)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] + [1.0] * 15), (3004, [float("nan")] * 16), (3005, [float("inf")] * 16), (3006, [1.0]), (3007, [2.0]), (3008, [1e-300] * 16), (3009, [1e300] * 16)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {x.vec_id: x for x in embeddings.near_duplicates(spark, clash(d)).collect()}
    want = brute_links(rows)
    assert want[3008] == want[3009] == (1, 3008)  # squares of these are beyond double
    total = sum(n for n, _ in want.values())
    assert len(out) == len(rows) and sum(x.n_links for x in out.values()) >= 0.98 * total
    assert all(out[i].n_links <= n for i, (n, _) in want.items())
    assert sum(out[i].component_id != c for i, (_, c) in want.items()) <= 2
    assert all(x.kept == (x.vec_id == x.component_id) for x in out.values())


def test_embeddings_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark, spark.createDataFrame([], kind)).count() == 0
    out = embeddings.near_duplicates(spark, spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None)], kind)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in out) == [(-1, 0, -1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_embedding_classes_have_two_keys(spark):
    """A constant hashed after the vector continues the first key and would add nothing to it; hashed before, it does."""
    d = spark.createDataFrame([([float(i), 1.0],) for i in range(50)], "e array<double>")
    k = d.select(F.xxhash64("e", F.lit(1)).alias("after"), F.xxhash64(F.lit(1), "e").alias("before")).collect()
    assert all(r.after != r.before for r in k) and len({r.before for r in k}) == 50


def test_vec_id_with_two_vectors(spark):
    rows = [(9, [1.0, 0.0]), (9, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    out = embeddings.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(2, 1, 2), (3, 1, 3), (9, 1, 2), (9, 1, 3)]


def test_visits_weigh_queries_alike():
    """A group that holds half of the sample does not decide how many cells are visited for the others."""
    r = np.random.default_rng(8)
    x = r.standard_normal((600, 8))
    x[300:] = x[0] + 0.01 * r.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = [embeddings.kmeans(x[:, :4], 6), embeddings.kmeans(x[:, 4:], 6)]
    assert 1 <= embeddings.visits_needed(x, codes) <= 36


def test_embeddings_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "embeddings").collect()]
    want = brute_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in queries.op4_embeddings(spark, DATA).collect()} == want


# 5 quality


def test_marginals_match_enumeration():
    from itertools import product

    r = np.random.default_rng(7)
    first = np.array([0, 1, 5, 8])
    u, trans = r.standard_normal(8), r.standard_normal((2, 2))
    good, moved = quality.marginals(u, trans, first, pairs=True)
    for a, b in zip(first[:-1], first[1:]):
        total, p, q = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in product((0, 1), repeat=b - a):
            w = np.exp(sum(u[a + i] * s for i, s in enumerate(y)) + sum(trans[s, t] for s, t in zip(y, y[1:])))
            total += w
            p += w * np.array(y)
            for s, t in zip(y, y[1:]):
                q[s, t] += w
        assert np.allclose(good[a:b], p / total) and np.allclose(moved[list(first).index(a)], q / total)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 80 and sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)


def test_samples_do_not_depend_on_arrival(spark, monkeypatch):
    """Bounded samples are the rows of least hash, however the table is dealt."""
    monkeypatch.setattr(quality, "SAMPLE_LINES", 300)
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 60_000)
    docs, labels = table(spark, "documents"), table(spark, "labels")
    train = docs.select(F.col("doc_id").alias("key"), "lang", "text")
    a, b = langid.fit(train), langid.fit(train.repartition(5, "lang"))
    assert (a.weights == b.weights).all() and a.temperature == b.temperature
    c, d = quality.fit(docs, labels), quality.fit(docs.repartition(5, "lang"), labels)
    assert (c.weights == d.weights).all() and c.slope == d.slope


def test_quality_edges(spark):
    labels = table(spark, "labels")
    docs = table(spark, "documents")
    out = quality.quality(spark, clash(docs.unionByName(odd_docs(spark).where("doc_id is null or doc_id < 9").withColumn("doc_id", F.col("doc_id") + 10_000))), labels).collect()
    assert len(out) == docs.count() + 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.score for r in quality.quality(spark, odd_docs(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.quality(spark, empty_docs(spark), labels).count() == 0


def test_lines():
    _, _, data, offs = next(K.slices(pa.array(["a\n\nb", "", "x\n", None])))
    x, lens, first = quality.line_features(data, offs)
    assert np.diff(first).tolist() == [3, 1, 2, 1] and lens.tolist() == [1, 0, 1, 0, 1, 0, 0] and np.isfinite(x).all()


# 6 MinHash


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, i in enumerate(ids):
        for j in ids[:p]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def mutated(r, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = prose(r, 1)
    return " ".join(w)


@pytest.mark.parametrize("seed", range(2))
def test_minhash(spark, seed, monkeypatch):
    """The second run takes every group of three as heavy and cuts buckets in chunks of seven."""
    if seed:
        monkeypatch.setattr(shared, "LEAST_HEAVY", 3)
        monkeypatch.setattr(shared, "MOST_HEAVY", 10**9)
        monkeypatch.setattr(minhash, "CHUNK_ROWS", 7)
        monkeypatch.setattr(minhash, "FOLLOWERS", 2)
    r = random.Random(seed)
    texts = [prose(r, r.randrange(1, 120)) for _ in range(60)]
    base = prose(r, 150)
    texts += [mutated(r, base, r.choice([0.01, 0.02, 0.03, 0.05])) for _ in range(80)]  # a group that straddles the threshold
    texts += [texts[3]] * 30 + [texts[5].upper()] + [mutated(r, t, 0.01) for t in texts[:40]]
    common = prose(r, 60)
    texts += [common + " " + prose(r, 25) for _ in range(40)]
    rows = list(enumerate(texts))
    out = minhash.near_duplicates(spark, clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == brute_components(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


def test_minhash_edges(spark):
    out = minhash.near_duplicates(spark, odd_docs(spark)).collect()
    assert len(out) == 10
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (None, 2, None, True), (5, 4, 5, True), (6, 4, 5, False), (7, 1, 7, True), (8, 1, 8, True)}
    assert minhash.near_duplicates(spark, empty_docs(spark)).count() == 0


def test_minhash_of_a_doc_id_with_two_texts(spark):
    r = random.Random(4)
    a, b = prose(r, 60), prose(r, 60)
    rows = [(9, a), (9, b), (9, b), (2, a + " more"), (3, b + " more")]
    out = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.component_id, x.kept) for x in out) == [(2, 2, True), (3, 3, True), (9, 2, False), (9, 3, False), (9, 3, False)]


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(9)
    x = r.integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 3, 50, 2000):
        s = minhash.sketches(np.unique(x[:n]), np.array([0, n]))
        assert (s != 0).all() and len(set(s[0].tolist())) > (0 if n == 1 else 1)
    a, b = np.unique(x[:900]), np.unique(x[100:1000])
    s = minhash.sketches(np.concatenate([a, b]), np.array([0, 900, 1800]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


def test_within_counts_are_exact():
    r = random.Random(3)
    for m in (5, 40):
        sets = [np.unique(np.array([r.randrange(60) for _ in range(r.randrange(1, 50))], dtype=np.uint64)) for _ in range(m)]
        links = {(i, j) for i in range(m) for j in range(m) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        got = minhash._links_within(sets)
        assert {(i, j) for i, j in got} <= links
        find = lambda pairs: {frozenset(c) for c in _closure(m, pairs)}
        assert find(got) == find(links)


def _closure(m, pairs):
    p = list(range(m))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for i, j in pairs:
        p[root(i)] = root(j)
    groups = defaultdict(set)
    for i in range(m):
        groups[root(i)].add(i)
    return groups.values()


def test_components(spark):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (200, 300 + 1)]
    pairs += [(500, 500 + i) for i in range(50)]
    out = graph.components(shared.Scratch(spark, "t"), spark.createDataFrame(pairs, "a long, b long")).collect()
    want = {min(g): g for g in _closure(600, pairs)}
    ids = {x for p in pairs for x in p}
    assert {x.id: x.component for x in out} == {i: next(m for m, g in want.items() if i in g) for i in ids}
    assert graph.components(shared.Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


# 7 language model


@pytest.mark.parametrize("name", ["op7_lm", "op9_warc", "op10_chat"])
def test_sql_twins(compare, name):
    compare(queries.QUERIES[name], queries.ORACLE[name])


def test_lm_edges(spark):
    out = lm.score(spark, clash(odd_docs(spark))).collect()
    assert len(out) == 10
    assert [(r.n_words, r.log10_score, r.log10_per_word) for r in out if r.doc_id in (1, 2, 3)] == [(0, 0.0, None)] * 3
    assert all(np.isfinite(r.log10_score) for r in out)
    assert lm.score(spark, empty_docs(spark)).count() == 0


def test_lm_many_slices(spark, monkeypatch):
    """Slices, pages and partitions of any size give the same scores."""
    docs = table(spark, "documents")
    want = {r.doc_id: r.log10_score for r in lm.score(spark, docs).collect()}
    monkeypatch.setattr(lm, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(lm, "PARTITION_WORDS", 5_000)
    assert {r.doc_id: r.log10_score for r in lm.score(spark, docs.repartition(3)).collect()} == want


def test_lm_own_counts(spark):
    """With a document's own counts no n-gram is unseen: a text that occurs once has S = 1 after its first word."""
    d = spark.createDataFrame([(1, "a b c"), (2, "d d e")], "doc_id long, text string")
    found = {r.doc_id: r.log10_score for r in lm.score(spark, d, leave_out=False).collect()}
    assert found == {1: round(float(np.log10(1 / 6)), 6), 2: round(float(np.log10(2 / 6 * 1 / 2)), 6)}


def test_lm_order_and_pages():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 2**63, 5000), r.integers(0, 50, 3000), (7 << 40) + r.integers(0, 2000, 3000)]).astype(np.uint64)
    assert (lm.sorted_order(x) == np.argsort(x, kind="stable")).all() and len(lm.sorted_order(x[:0])) == 0
    s = lm.Slice(pa.array([prose(random.Random(2), 4000), None, "a b " * 200], pa.large_string()))
    found = [row for turn in range(3) for b in s.pages(5, turn, 3) for row in zip(*(c.to_pylist() for c in b.columns))]
    assert len(found) <= 1 << lm.PAGE_BITS
    keys = [((page & 0xFFFF) << 48) + ((h & 0xFFFF) << 32) + (x & 0xFFFFFFFF) for _, page, hi, lo, _ in found for h, x in zip(hi, lo, strict=True)]
    assert keys == s.keys[s.entries()].tolist() and np.bincount(s.entries(), [x for *_, n in found for x in n]).astype(int).tolist() == s.counts.tolist()
    assert [place - (5 << 32) for place, *_ in found] == np.cumsum([0] + [len(n) for *_, n in found])[:-1].tolist()


# 8 decontamination


def brute_overlaps(text, item):
    """The best run over all alignments, without seeds."""
    tok = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    d, b = tok(text), tok(item)
    need = min(decontam.MIN_MATCHES, max(decontam.SEED_TOKENS, -(-len(b) * 8 // 10)))
    for shift in range(-len(b), len(d)):
        same = np.array([0 <= i + shift < len(d) and d[i + shift] == b[i] for i in range(len(b))])
        if same.sum() >= need:
            s, e = decontam.best_run(same)
            if same[s:e].sum() >= need and same[s:e].mean() >= decontam.MIN_IDENTITY:
                return True
    return False


def test_decontamination(spark):
    r = random.Random(8)
    items = [(i, prose(r, r.choice([6, 9, 15, 30, 50]))) for i in range(12)] + [(90, "too short"), (91, None), (None, prose(r, 20))]
    texts = []
    for _, t in items[:12]:
        w = t.split()
        texts.append(prose(r, 30) + ". " + t.upper() + "! " + prose(r, 9))
        for step in (4, 5, 6, 8):
            texts.append(prose(r, 10) + " " + " ".join(prose(r, 1) if i % step == step - 1 else x for i, x in enumerate(w)) + " " + prose(r, 10))
    texts += [prose(r, 80) for _ in range(20)] + [items[-1][1]]
    rows = list(enumerate(texts))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(spark, clash(d), clash(b)).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    want = {(i, k) for i, t in rows for k, item in items if item and brute_overlaps(t, item)}
    assert got <= want
    exact = {(5 * k, k) for k in range(12)}
    assert exact <= got and (len(rows) - 1, None) in got
    assert len(got) >= 0.9 * len(want)
    assert not {i for i, _ in got} & set(range(60, 80))


def test_best_run_enumerated():
    r = random.Random(12)
    for n in [0, 1, 5, 20, 59] * 40:
        same = np.array([r.random() < r.choice([0.3, 0.7, 0.8]) for _ in range(n)], dtype=bool)
        every = [(int(same[i:j].sum()), -i, j - i) for i in range(n) for j in range(i + 1, n + 1) if 4 * same[i:j].sum() >= 3 * (j - i)]
        s, e = decontam.best_run(same)
        most = max((m for m, _, _ in every), default=0)
        assert same[s:e].sum() == most and 4 * same[s:e].sum() >= 3 * (e - s)
        if most:
            assert s == min(-i for m, i, k in every if m == most and same[-i] and same[-i + k - 1])


def test_decontamination_of_thinning_copies(spark):
    r = random.Random(13)
    same = [[True] * 10 + [False, True, True] * k + [True] for k in (12, 13, 16)]
    same += [[True] * 12 + [i % 10 not in (0, 3, 6) for i in range(90)]]
    items = [prose(r, len(x)) for x in same]
    docs = [prose(r, 9) + " " + " ".join(w if ok else "zz" + prose(r, 1) for w, ok in zip(t.split(), x)) + " " + prose(r, 9) for t, x in zip(items, same)]
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = decontam.contaminated(spark, d, b).collect()
    assert {(x.doc_id, x.item_id) for x in out} >= {(i, i) for i in range(4)}
    assert all(x.matches >= 10 and 4 * x.matches >= 3 * x.run_tokens for x in out)


def test_decontamination_of_any_script_and_short_items(spark):
    items = [
        (1, "下列哪一个城市是法国的首都巴黎还是里昂"), (2, "the word “don’t” is written — as one knows — with an apostrophe in it"),
        (3, "zwei Wörter"), (4, "日本の首都"), (5, "größe"), (6, "six\u00a0tokens of text\u00a0are here"),
    ]
    docs = [
        (1, "前文在此。下列哪一个城市是法国的首都？巴黎还是里昂！后文"), (2, 'So: the word "don\'t" is written - as one knows - with an apostrophe in it.'),
        (3, "Das sind ZWEI WÖRTER, zwei Wörter."), (4, "これは日本の首都です"), (5, "Die Größen"), (6, "some six tokens of text are here"), (7, "zwei andere Wörter"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {(x.doc_id, x.item_id): (x.matches, x.doc_token) for x in decontam.contaminated(spark, d, b).collect()}
    assert set(out) == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 6)} and out[3, 3] == (2, 2) and out[4, 4] == (5, 3)
    notice = "“Released under the MIT\u00a0License”—see"
    assert [x.license_id for x in licenses.scan(spark, spark.createDataFrame([(1, notice)], "doc_id long, text string")).collect()] == ["MIT"]


def test_decontamination_by_shuffle(spark, monkeypatch):
    d = table(spark, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "so few words here"), (-1, "x so few words here y")], "doc_id long, text string"))
    b = table(spark, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame([(77_777, "few words"), (77_778, None)], "item_id long, text string"))
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    want = order(decontam.contaminated(spark, d, b).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(shared, "LEAST_HEAVY", 3)
    assert {r.doc_id for r in want if r.item_id == 77_777} == {None, -1}
    assert order(decontam.contaminated(spark, d, b).collect()) == want and want


def test_decontamination_edges(spark):
    b = table(spark, "benchmark")
    assert decontam.contaminated(spark, odd_docs(spark), b).count() == 0
    assert decontam.contaminated(spark, empty_docs(spark), b).count() == 0
    assert decontam.contaminated(spark, odd_docs(spark), b.limit(0)).count() == 0


# 9 WARC


def test_warc_edges(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (2, "u", "same"), (None, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "é" * 200_000), (None, "u", "only"), (None, "u", "only")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.round_trip(spark, clash(d)).collect()
    key = lambda r: (r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to or -1)
    assert sorted(map(key, out)) == sorted([(1, 4, "revisit", 2), (2, 4, "response", -1), (2, 4, "response", -1), (-1, 4, "revisit", 2), (3, 0, "revisit", 4), (4, 0, "response", -1), (5, 400_000, "response", -1), (-1, 4, "response", -1), (-1, 4, "response", -1)])
    assert {r.payload_digest for r in out if r.payload_bytes == 0} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}
    assert warc.round_trip(spark, d.limit(0)).count() == 0


def test_warc_rolls_and_heavy_digests(spark, monkeypatch):
    monkeypatch.setattr(shared, "LEAST_HEAVY", 10)
    d = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "popular").otherwise(F.sha2(F.col("id").cast("string"), 512)).alias("html"))
    scratch = shared.Scratch(spark, "t")
    manifest = warc.write_archives(scratch, d.repartition(2), roll_bytes=20_000)
    found = manifest.collect()
    assert len(found) > 4 and sum(r.records for r in found) == 400 and all(r.bytes < 21_000 for r in found)
    out = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect()}
    assert len(out) == 400 and all(out[i] == (("revisit", 399) if i % 3 == 0 and i < 399 else ("response", None)) for i in range(400))


def broken(spark, column):
    """Rows whose text is not valid UTF-8."""
    return spark.sql(f"select id as doc_id, id as page_id, 'en' lang, 'u' url, cast(concat(x'4142e9', cast(concat(' one two three ', id) as binary), x'ff') as string) {column} from range(6)")


def test_bytes_that_are_not_utf8(spark):
    d = broken(spark, "text")
    assert {r.lang_pred for r in langid.identify(spark, d).collect()} == {"en"}
    assert minhash.near_duplicates(spark, d).count() == packing.pack(spark, d).count() == lm.score(spark, d).count() == 6
    assert quality.quality(spark, d, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).count() == 6
    out = warc.round_trip(spark, broken(spark, "html")).collect()
    assert [r.payload_bytes for r in out] == [3 + len(" one two three 0") + 1] * 6


def test_warc_reader_refuses_damage():
    good = warc.encode_record(1, "u", b"payload" * 50_000, None, False) + warc.encode_record(2, "u", b"", 1, True)
    assert [warc.page(r["record_id"]) for r in warc.read_records(io.BytesIO(good))] == [1, 2]
    import zlib

    text = zlib.decompress(warc.encode_record(1, "u", b"payload", None, False), 31)

    def packed(x):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()

    for bad in (good[:-20], packed(text.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n")), packed(text[:-6]), packed(text + b"more"), packed(b"no header")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_warc_reader_of_other_writers():
    """Records of all types, ids of any form, digests that are missing or of other algorithms, long blocks without an empty line."""
    import base64
    import hashlib
    import zlib

    def packed(head, block, version="WARC/1.0"):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        text = "\r\n".join([version, *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
        return c.compress(text) + c.flush()

    body, http = b"<p>hello</p>" * 20_000, b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    archive = [
        packed(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:aa>", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        packed(["WARC-Type: request", "WARC-Record-ID: <urn:uuid:ab>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"),
        packed(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:ac>", "Content-Type: application/http;", "  msgtype=response", f"WARC-Payload-Digest: sha1:{sha}", "WARC-Target-URI: http://x/", "WARC-Block-Digest: md5:" + hashlib.md5(http + body).hexdigest()], http + body, "WARC/1.1"),
        packed(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:ad>", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{sha}"], chunked),
        packed(["WARC-Type: resource", "WARC-Record-ID: <urn:uuid:ae>", "Content-Type: image/png", "WARC-Payload-Digest: crc9:zz"], b"\x00" * 3_000_000),
        packed(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:af>", "Content-Type: application/http"], b"y" * 3_000_000),
        packed(["WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:ba>"], b""),
        packed(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:bb>", "WARC-Refers-To: <urn:uuid:ac>", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{sha}"], b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n"),
    ]
    got = list(warc.read_records(io.BytesIO(b"".join(archive))))
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "resource", "response", "metadata", "revisit"]
    assert [r["payload_bytes"] for r in got] == [13, 0, len(body), 15, 3_000_000, 3_000_000, 0, 77]
    assert got[0]["record_id"] == "<urn:uuid:aa>" and warc.page(got[0]["record_id"]) is None and got[7]["refers_to"] == "<urn:uuid:ac>"
    assert got[2]["payload_digest"] == sha and got[2]["target_uri"] == "http://x/" and got[4]["payload_digest"] == base64.b32encode(hashlib.sha1(b"\x00" * 3_000_000).digest()).decode()
    for bad in (packed(["WARC-Type: resource", "WARC-Block-Digest: sha256:" + "0" * 64], b"x"), packed(["WARC-Type: resource"], b"x", "HTTP/1.1")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


# 10 chat


def test_chat_edges(spark):
    kind = "pair_id long, side string, turn long, role string, text string"
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "ok")]
    rows = [(1, "chosen", i, *t) for i, t in enumerate(a)] + [(1, "rejected", i, *t) for i, t in enumerate(a[:3] + [("assistant", "no way")])]
    rows += [(2, s, i, *t) for s in ("chosen", "rejected") for i, t in enumerate(a)] + [(3, "chosen", None, None, None), (None, "chosen", 1, "user", "x"), (4, "other", 1, "user", "x")]
    out = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(rows, kind)).collect()}
    assert set(out) == {1, 2, 3}
    one = out[1]
    assert one.prompt_turns == 3 and one.prompt.endswith("more<|im_end|>\n")
    for side, mask, want in ((one.chosen, one.chosen_mask, "ok"), (one.rejected, one.rejected_mask, "no way")):
        begin, end = map(int, mask.split(":"))
        assert side[begin:end] == want + "<|im_end|>\n" and end == len(side)
    assert (out[2].prompt_turns, out[2].chosen, out[2].rejected, out[2].chosen_mask) == (4, "", "", "")
    assert out[3].prompt_turns == 0 and out[3].rejected == ""
    assert chat.preference_pairs(spark.createDataFrame([], kind)).count() == 0
    conv = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "long reply"), (1, 1, "assistant", "long reply"), (2, 0, None, None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert {r.pair_id: r.prompt_turns for r in chat.preference_pairs(chat.truncated_replies(clash(conv).drop("pair_id", "side"))).collect()} == {1: 2, 2: 1}


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language", "quality", "near_dedup", "decontaminate", "pack"]
    docs = table(spark, "documents").unionByName(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 50_000))
    columns = docs.columns
    scratch = shared.Scratch(spark, "test")
    for name, f in P.STAGES:
        out = scratch.write(f(spark, docs, DATA), name)
        before = {r.doc_id: r.text for r in docs.collect()}
        left = {r.doc_id for r in out.collect()}
        assert left <= set(before)
        if name != "pack":
            assert out.columns == columns
            assert all(before[r.doc_id] == r.text for r in out.collect())
        if name == "language":
            assert not left & {50_001, 50_002, 50_003, 50_007} and len(set(before) - left) <= 8
        if name == "quality":
            bad = {r.doc_id for r in table(spark, "labels").where("quality = 0").collect()}
            good = {r.doc_id for r in table(spark, "labels").where("quality = 1").collect()} & set(before)
            assert len(left & bad) <= 2 and len(good - left) <= 0.03 * len(good) + 1
        if name == "near_dedup":
            want = brute_components([(i, t) for i, t in before.items() if i is not None])
            assert {i for i in left if i is not None} == {i for i, (_, c) in want.items() if i == c}
        if name == "decontaminate":
            items = [r.text for r in table(spark, "benchmark").collect()]
            leaked = {i for i, t in before.items() if any(" ".join(re.findall(r"\w+", x.lower())) in " ".join(re.findall(r"\w+", t.lower())) for x in items)}
            assert not left & leaked and set(before) - left == leaked
        if name == "pack":
            assert left == set(before) and out.count() == docs.count()
        docs = out


def test_pipeline_run(spark):
    import corpus_pipeline as P

    assert P.run(spark, DATA).count() > 0


def test_pipeline_with_clashing_columns(spark):
    """Every stage carries extra columns named as the operators' own and keeps the rows that it keeps without them."""
    import corpus_pipeline as P

    docs = table(spark, "documents").limit(80).unionByName(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 50_000))
    own = ["lang_pred", "letters", "_0", "_1", "rows", "kept", "n_tokens", "slot", "quality", "row", "u", "v", "k2", "item_id"]
    extra = clash(docs).withColumns({c: F.lit(f"{c}!") for c in own})
    for name, f in P.STAGES:
        plain, out = f(spark, docs, DATA), f(spark, extra, DATA)
        count = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
        if name == "pack":
            assert count(out) == count(plain)
            continue
        assert count(out) == count(plain) and out.columns == extra.columns
        assert {(r.score, r.body, r.lang_pred, r._0, r.letters) for r in out.collect()} == {("x", "x", "lang_pred!", "_0!", "letters!")}


def test_language_counts_are_not_cut(spark):
    """An n-gram that a text holds more than 65,535 times has its whole count."""
    long, many = "a" * 70_000, spark.createDataFrame([(i, "x" * 9 + " y", "en") for i in range(30)] + [(99, "a" * 70_000, "de")], "key long, text string, lang string")
    found = many.select("lang", F.lit(1).cast("long").alias("place"), "text").mapInArrow(langid._statistics(), "lang string, place long, ids binary, counts binary, bucket long, df long")
    row = found.where("lang = 'de'").first()
    assert np.frombuffer(row.counts, dtype=np.uint32).max() == len(long)
    frequency = {r.bucket: r.df for r in found.where("bucket is not null").groupBy("bucket").agg(F.sum("df").alias("df")).collect()}
    assert frequency[langid.BUCKETS] == 31 and max(v for k, v in frequency.items() if k < langid.BUCKETS) == 30


def test_many_texts_of_one_doc_id(spark):
    """Texts that share a doc_id are classes of their own and are linked as under ids of their own."""
    r = random.Random(12)
    base = [prose(r, 60) for _ in range(60)]
    texts = [t for b in base for t in (b, b + " and more", prose(r, 60))]
    one = minhash.near_duplicates(spark, spark.createDataFrame([(7, t, None, None, 1) for t in texts], DOCS)).collect()
    own = minhash.near_duplicates(spark, spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], DOCS)).collect()
    assert sorted(x.n_shingles for x in one) == sorted(x.n_shingles for x in own) and all(x.kept and x.component_id == 7 for x in one)
    assert len({x.component_id for x in own}) == 120
