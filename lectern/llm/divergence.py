"""Divergence of the sources of a language, by an inverted index of corrections to a baseline.

Every term of a source has a smoothed share, a whole number p. The value of two sources is the sum of |p - q| over all kept
terms of their language. Each pair starts at the baseline, the number of kept terms times the difference of the shares that a term
of count zero has; then only the postings, the sources that a term occurs in, correct it:

* a posting against a source without the term: the correction depends on p alone, so postings of a source are counted by p first;
* two postings of one term: the join of the index with itself by (lang, term) corrects what the two said on their own.

Corrections of zero are not emitted. Tokens are counted in the tasks that read the texts, by Arrow dictionaries, so no word is ever
hashed to a key that another could share; all else is DataFrame code over whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import kernel as K
from .shared import Scratch, spread_join

#: A term is kept where this many documents of its language have it.
LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
#: Ranks of the terms that a source has more of than its language: a fixed part of the report.
TOP_TERMS = 50
#: Bytes of text of which the words are counted at a time.
SLICE = 4 << 20

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
COUNTS = "lang string, source string, term string, tf long, df long"


def words_of(data: np.ndarray, offs: np.ndarray, separator: np.ndarray, fold: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words as a dictionary array, text of each word) of a slice; words are compared by their bytes."""
    w = K.Words(data, offs, separator, fold, hashed=False)
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)])
    flat = fold[data[~separator[data]]]
    plain = pa.Array.from_buffers(pa.large_string(), len(w.start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
    return plain.dictionary_encode(), w.doc()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, tf, df) of every slice of (lang, source, text)."""
    for batch in batches:
        for lo, hi, data, offs in K.slices(batch.column(2), SLICE):
            group, names = {}, []
            of = np.empty(hi - lo, dtype=np.int64)
            for d, key in enumerate(zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist())):
                if key not in group:
                    group[key] = len(names)
                    names.append(key)
                of[d] = group[key]
            found, doc = words_of(data, offs, SEPARATOR, K.LOWER)
            size = max(len(found.dictionary), 1)
            key, tf = np.unique(doc * size + found.indices.to_numpy(), return_counts=True)
            key, at = np.unique(of[key // size] * size + key % size, return_inverse=True)
            owner = key // size
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n[0] for n in names], pa.string()).take(pa.array(owner)),
                    pa.array([n[1] for n in names], pa.string()).take(pa.array(owner)),
                    found.dictionary.take(pa.array(key % size)).cast(pa.string()),
                    pa.array(np.bincount(at, tf, len(key)).astype(np.int64)),
                    pa.array(np.bincount(at, minlength=len(key))),
                ],
                names=["lang", "source", "term", "tf", "df"],
            )


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH terms)), in decimals of 38 digits; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = (wide(count) + F.lit(SMOOTH)) * F.lit(SCALE)
    below = wide(total) + F.lit(SMOOTH).cast("decimal(5,0)") * wide(terms)
    return F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(20,0)"))) + F.lit(1).cast("long")


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for every source of a language in ``docs`` (text, lang, source).

    Part ``pair``: a row for each other source of the language, the most different first. Part ``term``: the terms that the source
    has a greater share of than its language, the first ``top_terms``. A term is a run of letters A-Z, a-z and characters beyond
    ASCII, A-Z lowered; it is kept if ``least_docs`` rows of its language have it. Null texts, languages and sources are ''. Every
    row is a document, a repeated one too. Equal values go by item in order of its bytes. A language without kept terms has pairs of
    value 0 and no terms, one with a single source has no pairs. No rows give none; other columns are ignored.
    """
    scratch = Scratch(spark, "divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    counts = rows.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    # a term has a row for each source at most
    term = W.partitionBy("lang", "term")
    kept = counts.withColumns({"docs": F.sum("df").over(term), "total": F.sum("tf").over(term), "lead": F.min("source").over(term) == F.col("source")})
    kept = scratch.write(kept.where(F.col("docs") >= least_docs).select("lang", "source", "term", "tf", "total", "lead"), "kept")

    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("terms"), F.sum("tf").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n"), F.count("*").alias("m"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "m", "terms", "lang_total")])
    groups = scratch.write(groups.withColumn("zero", share(F.lit(0), F.col("n"), F.col("terms"))), "groups")

    index = spread_join(kept, groups, ["lang", "source"])
    index = index.select("lang", "term", "source", share(F.col("tf"), F.col("n"), F.col("terms")).alias("p"), "zero", share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"))
    index = scratch.write(index, "index")

    pairs = _pairs(groups, index)
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s")
    pairs = pairs.select("lang", "value", both).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(by_value))
    # the limit on ranks is applied by Spark before its shuffle too, so no task sorts all terms of a source
    terms = index.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)


def _pairs(groups: DataFrame, index: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a < b: the baseline of each pair and the corrections that are not zero."""
    named = lambda df, side, **cols: df.select("lang", F.col("source").alias(side), *[F.col(c).alias(n) for n, c in cols.items()])
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    others = named(groups, "b", zero_b="zero")
    sides = named(groups, "a", zero_a="zero", terms="terms").join(others, "lang")
    start = sides.where("a < b").select("lang", "a", "b", F.coalesce(F.col("terms") * gap("zero_a", "zero_b"), F.lit(0)).alias("value"))

    alone = index.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("times"))
    alone = named(alone, "a", p="p", zero_a="zero", times="times").join(others, "lang").where("a != b")
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("times") * (gap("p", "zero_b") - gap("zero_a", "zero_b"))).alias("value"))

    posting = lambda side: index.select("lang", "term", F.col("source").alias(side), F.col("p").alias(f"p_{side}"), F.col("zero").alias(f"zero_{side}"))
    met = posting("a").join(posting("b"), ["lang", "term"]).where("a < b")
    met = met.select("lang", "a", "b", (gap("p_a", "p_b") - gap("p_a", "zero_b") - gap("p_b", "zero_a") + gap("zero_a", "zero_b")).alias("value"))
    changes = alone.unionByName(met).where("value != 0")
    return start.unionByName(changes).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


ORACLE = f"""
with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t, row_number() over () r from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
kept as (select lang, term, count(*) total from w group by lang, term having count(distinct r) >= {LEAST_DOCS}),
c as (select lang, source, term, count(*) tf from w join kept using (lang, term) group by all),
g as (select lang, source, coalesce(n, 0) n, coalesce(v, 0) v, coalesce(nl, 0) nl from (select distinct lang, source from d) left join (select lang, source, sum(tf) n from c group by all) using (lang, source)
 left join (select lang, count(*) v, sum(total) nl from kept group by lang) using (lang)),
p as (select g.lang, g.source, term, coalesce(tf, 0) tf, 1 + ({SCALE}::hugeint * (coalesce(tf, 0) + {SMOOTH})::hugeint) // (n + {SMOOTH} * v)::hugeint p, 1 + ({SCALE}::hugeint * (total + {SMOOTH})::hugeint) // (nl + {SMOOTH} * v)::hugeint q
 from g join kept using (lang) left join c using (lang, source, term)),
two as (select x.lang, x.source, y.source item, sum(abs(x.p - y.p)) f from p x join p y on x.lang = y.lang and x.term = y.term and x.source != y.source group by all),
pairs as (select x.lang, x.source, 'pair' part, y.source item, coalesce(f, 0)::bigint value from g x join g y on x.lang = y.lang and x.source != y.source left join two on two.lang = x.lang and two.source = x.source and two.item = y.source),
terms as (select lang, source, 'term' part, term item, (p - q)::bigint value from p where tf > 0 and p > q),
u as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int "rank" from (select * from pairs union all select * from terms))
select * from u where part = 'pair' or "rank" <= {TOP_TERMS}
"""
