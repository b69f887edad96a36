"""The registered queries: every operator over the given tables, with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import scoring as S, text as X
from ..operators import books, chunks, coach, corpus, fold, games, grammar, index, positions, search
from ..sources import known, markup, pgn, sinks
from ..sources.files import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORDS = "regexp_extract_all(lower(text), '[^\\s]+')"
TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
FOLDED = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+')"
SQUEEZED = "trim(regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+', ' ', 'g'))"
SEARCH_WORDS = ["the", "with", "from"]
OTHER_WORDS = ["that", "this"]
VOCABULARY = {"in_the": 5, "plan": 3, "that": 2, "er": 1}

GAME_ONE = """[Event "Club Training"]
[Site "Hall"]
[Date "1995.05.01"]
[Round "1"]
[White "A"]
[Black "B"]
[Result "1-0"]
[WhiteElo "2000"]
[BlackElo "1900"]

1. e4 {The plan is to take space in the center and develop quickly} e5
2. Nf3 {A typical idea} Nc6 3. Bb5! (3. Bc4 {is calm}) a6 1-0"""
GAME_TWO = """[Event "Chessable Course"]
[Site "?"]
[Date "????.??.??"]
[White "Introduction"]
[Black "?"]
[Result "*"]

1. d4 d5 2. c4 $1 e6 {Stockfish says +1.23 depth 20} *"""
FENS = [
    (1, "rnbqkbnr/pp1ppppp/8/2p5/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"),
    (2, "rnbqkbnr/pppp1ppp/4p3/8/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"),
    (3, "8/8/8/8/8/8/8/K1k5 w - - 0 1"),
    (4, "not a position"),
]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _bm25_sql(words: list[str], joiner: str = "and", phrase: bool = False) -> str:
    """CTE ``hit`` (doc_id, source, text, score) over documents."""
    n = len(words) + phrase
    tf = ", ".join([f"len(list_filter(w, lambda x: x = '{k}')) f{i}" for i, k in enumerate(words)] + ([f"(length(j) - length(replace(j, ' {'  '.join(words)} ', ''))) // {len('  '.join(words)) + 2} f{n - 1}"] if phrase else []))
    df = ", ".join(f"count(*) filter (f{i} > 0) d{i}" for i in range(n))
    part = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(n))
    where = f" {joiner} ".join(f"f{i} > 0" for i in range(len(words)))
    where = f"({where}) or f{n - 1} > 0" if phrase else where
    return f"""t as (select *, {FOLDED} w from documents), t1 as (select *, '  ' || array_to_string(w, '  ') || '  ' j from t),
    f as (select doc_id, source, lang, text, len(w) len, {tf} from t1),
    st as (select count(*) n, avg(len) avg, {df} from f), hit as (select doc_id, source, lang, text, -({part}) score from f, st where {where})"""


_ROUND = "floor({} * 1e6 + 0.5) / 1e6"


def stored(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of the documents, written once for each content of the table."""
    return index.of_table(spark, docs(spark, sf_dir), f"{sf_dir}/documents.parquet")


def words_tree(words: list[str], any_word: bool = False) -> grammar.Node:
    return (grammar.some if any_word else grammar.every)(*[grammar.phrase(*grammar.terms_of(w)) for w in words])


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", X.rounded(F.col("score")))


@query(f"with {_bm25_sql(SEARCH_WORDS)} select doc_id, hit.source title, {_ROUND.format('score')} score, coalesce(quality, 0) quality from hit left join labels using (doc_id) order by 3, 4 desc, 1 limit 20")
def concept_search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: BM25 of all words, joined to quality, best 20; blocks of postings that cannot hold one of them are not read."""
    hits = _shown(stored(spark, sf_dir).best(words_tree(search.query_terms("what is " + " ".join(SEARCH_WORDS), ["what", "is"])), 20))
    out = docs(spark, sf_dir).select("doc_id", F.col("source").alias("title")).join(hits, "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return out.select("doc_id", "title", "score", F.coalesce("quality", F.lit(0)).alias("quality")).orderBy("score", F.desc("quality"), "doc_id").limit(20)


@query(f"with {_bm25_sql(['of', 'the'], phrase=True)} select doc_id, {_ROUND.format('score')} score from hit")
def search_phrase_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase or all words; every hit with its score."""
    return _shown(stored(spark, sf_dir).scored(grammar.some(words_tree(["of", "the"]), grammar.phrase("of", "the"))))


@query(f"with {_bm25_sql(['qqqq', 'the', 'und'], 'or')} select doc_id, {_ROUND.format('score')} score from hit")
def search_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No document has all the words, so any of them serves."""
    found, words = stored(spark, sf_dir), ["qqqq", "the", "und"]
    return _shown(search.with_fallback(found.scored(grammar.some(grammar.phrase(*words), words_tree(words))), found.scored(words_tree(words, True))))


@query("select doc_id, left(text, 140) preview from documents where text ilike '%MIT License%'")
def like_fallback_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.like(docs(spark, sf_dir), "MIT License").select("doc_id", F.substring("text", 1, 140).alias("preview"))


@query(f"""with {_bm25_sql(OTHER_WORDS, 'or')},
h as (select doc_id, source title, lang chapter, text content, {_ROUND.format('score')} score from hit),
k as (select * from h where title not ilike '%index%' and chapter not ilike '%index%' and not starts_with(trim(lower(left(content, 100))), 'index of') and not starts_with(trim(lower(left(content, 100))), 'index (')
 and not starts_with(trim(lower(left(content, 100))), 'bibliography') and not starts_with(trim(lower(left(content, 100))), 'copyright') and not starts_with(trim(lower(left(content, 100))), 'contents') and not starts_with(trim(lower(left(content, 100))), 'preface')),
r as (select *, row_number() over (partition by title, left(content, 100) order by score, doc_id) r from k)
select doc_id, title, score from r where r = 1 order by score, doc_id limit 40""")
def search_noise_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _passages(spark, sf_dir).join(_shown(stored(spark, sf_dir).scored(words_tree(OTHER_WORDS, True))), "doc_id")
    return search.first_of_each(search.without_noise(hits), [F.col("score"), F.col("doc_id")]).select("doc_id", "title", "score").orderBy("score", "doc_id").limit(40)


@query(f"""with {_bm25_sql(SEARCH_WORDS)}, a as (select doc_id, row_number() over (order by {_ROUND.format('score')}, doc_id) r from hit qualify r <= 50),
b as (select doc_id, row_number() over (order by n_chars desc, doc_id) r from documents qualify r <= 50),
u as (select doc_id, 1.0 / (60 + r) s from a union all select doc_id, 0.5 / (60 + r) from b)
select doc_id, floor(sum(s) * 1e9 + 0.5) / 1e9 score, count(*) lists from u group by doc_id""")
def rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two top-50 lists merged by reciprocal rank."""
    d = docs(spark, sf_dir)
    top = lambda rows, *by: rows.orderBy(*by).limit(50).withColumn("rank", F.row_number().over(W.orderBy(*by)))  # noqa: E731  over 50 rows
    a = top(_shown(stored(spark, sf_dir).best(words_tree(SEARCH_WORDS), 50)), "score", "doc_id").select("doc_id", "rank", F.lit(1.0).alias("weight"))
    b = top(d.select("doc_id", "n_chars"), F.desc("n_chars"), "doc_id").select("doc_id", "rank", F.lit(0.5).alias("weight"))
    return search.reciprocal_rank_fusion(a.union(b)).select("doc_id", X.rounded(F.col("score"), 9).alias("score"), "lists")


@query(f"""with {_bm25_sql(SEARCH_WORDS)}, h as (select *, row_number() over (order by {_ROUND.format('score')}, doc_id) r from hit qualify r <= 5)
select string_agg('SOURCE ' || r || ': [' || source || '] (' || lang || ')' || chr(10) || left(text, 300), chr(10) || chr(10) order by r) context from h""")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt context of the five best hits."""
    hits = _passages(spark, sf_dir).join(_shown(stored(spark, sf_dir).best(words_tree(SEARCH_WORDS), 5)), "doc_id").withColumn("content", F.substring("content", 1, 300))
    return search.context(hits.orderBy("score", "doc_id").limit(5).withColumn("rank", F.row_number().over(W.orderBy("score", "doc_id"))))


@query(f"""with t as (select doc_id, unnest({FOLDED}) term, unnest(range(len({FOLDED}))) p from documents)
select term, doc_id, count(*) tf, string_agg(p::varchar, ',' order by p) positions from t group by term, doc_id""")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of all documents."""
    found = stored(spark, sf_dir).all_postings()
    return found.select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.col("source").alias("title"), F.col("lang").alias("chapter"), F.col("text").alias("content"))


_NOISY_TITLE = " and ".join(f"title not ilike '%{k}%' and chapter not ilike '%{k}%'" for k in search.NOISE_TITLES)
_NOISY_START = " or ".join(f"starts_with(trim(lower(left(content, 100))), '{p}')" for p in search.NOISE_PREFIXES)


def _library_sql(hit: str) -> str:
    return f"""with {hit}, h as (select doc_id, source title, lang chapter, text content, score from hit), k as (select * from h where {_NOISY_TITLE} order by score, doc_id limit 80),
r as (select *, row_number() over (partition by title, left(content, 100) order by score, doc_id) f from k where not ({_NOISY_START}))
select doc_id, {_ROUND.format('score')} score, row_number() over (order by score, doc_id) "rank" from r where f = 1 order by "rank" limit 10"""


@query(_library_sql(_bm25_sql(["that", "under"], phrase=True)))
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question: its meaningful words as a phrase, or all of them; noise and repetitions go after an over-fetch."""
    found = index.library(stored(spark, sf_dir), _passages(spark, sf_dir), "What are the key ideas of THAT, under?")
    return found.select("doc_id", X.rounded(F.col("score")).alias("score"), "rank")


@query(_library_sql(_bm25_sql(["qqqq", "that"], "or")))
def library_search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of which no document has all the words."""
    found = index.library(stored(spark, sf_dir), _passages(spark, sf_dir), "Explain Qqqq: that")
    return found.select("doc_id", X.rounded(F.col("score")).alias("score"), "rank")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.withColumn("quality", F.coalesce("quality", F.lit(0)))


@query(f"""with {_bm25_sql(['with', 'from'])}, r as (select doc_id, score, row_number() over (order by score, coalesce(quality, 0) desc, doc_id) "rank" from hit left join labels using (doc_id) qualify "rank" <= 10)
select doc_id, {_ROUND.format('score')} score, "rank", count(*) over () total from r""")
def concept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a query, from the index; the total counts the rows shown."""
    found = index.concept(stored(spark, sf_dir), _rated(spark, sf_dir), "What is the With from")
    return found.select("doc_id", X.rounded(F.col("score")).alias("score"), "rank", "total")


@query("""with r as (select doc_id, row_number() over (order by doc_id) "rank" from documents where text ilike '%MIT License.%' qualify "rank" <= 10) select doc_id, "rank", count(*) over () total from r""")
def concept_search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that the search syntax refuses becomes a substring search."""
    return index.concept(stored(spark, sf_dir), _rated(spark, sf_dir), "MIT License.").select("doc_id", "rank", "total")


@query("select source book_id, count(*) diagrams, count(*) filter (quality = 1) ocr from labels join documents using (doc_id) group by source")
def diagram_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand in for diagrams, documents for chunks, sources for books."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") == 1).alias("is_ocr_based"))
    return books.diagram_audit(marks, docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("book_id")))


def _grammar_sql(hit: str, phrases: list[str], where: str) -> str:
    """CTE ``hit`` (doc_id, score) of the documents for which ``where`` holds over f0, f1, ..: the counts of ``phrases`` as they stand in the joined terms."""
    count = [f"(length(j) - length(replace(j, ' {p} ', ''))) // {len(p) + 2} f{i}" for i, p in enumerate(phrases)]
    return f"""t as (select doc_id, {FOLDED} w from documents), j as (select *, '  ' || array_to_string(w, '  ') || '  ' j from t), f as (select *, {', '.join(count)} from j), {hit} as (select * from f where {where})"""


@query(f"""with {_grammar_sql('m', ['of', 'the', 'from', 'und', 'that', 'with'], "(f0 > 0 and f1 > 0 or f3 > 0) and not (f4 > 0 or f5 > 0 and f2 > 0)")},
s as (select count(*) n, avg(len(w)) av, count(*) filter (f0 > 0) d0, count(*) filter (f1 > 0) d1, count(*) filter (f3 > 0) d3 from f),
k as (select doc_id, len(w) l, f0 > 0 and f1 > 0 b, * from m, s)
select doc_id, floor(-((case when b then greatest(ln((n - d0 + .5) / (d0 + .5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (.25 + .75 * l / av)) + greatest(ln((n - d1 + .5) / (d1 + .5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (.25 + .75 * l / av)) else 0 end)
 + greatest(ln((n - d3 + .5) / (d3 + .5)), 1e-6) * f3 * 2.2 / (f3 + 1.2 * (.25 + .75 * l / av))) * 1e6 + 0.5) / 1e6 score from k""")
def search_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, brackets and operators of the search syntax, compiled to one pass over the postings of the words."""
    return _shown(stored(spark, sf_dir).scored(grammar.parsed("((of AND the) OR und) NOT (that OR (with from))")))


@query(f"""with t as (select doc_id, {FOLDED} w from documents), p as (select doc_id, unnest(w) term, unnest(range(len(w))) pos from t),
pre as (select distinct doc_id from p where starts_with(term, 'qu') or term = 'und'),
near as (select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id and a.term = 'of' and b.term = 'with' and greatest(a.pos, b.pos) - least(a.pos, b.pos) <= 4)
select doc_id, near.doc_id is not null near from pre full join near using (doc_id)""")
def search_near_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words near each other, beginnings of words, and which of both a document has."""
    found = stored(spark, sf_dir)
    near = found.scored(grammar.parsed("NEAR(of with, 3)")).select("doc_id", F.lit(True).alias("near"))
    return found.scored(grammar.parsed("qu* OR und")).select("doc_id").join(near, "doc_id", "full").select("doc_id", F.coalesce("near", F.lit(False)).alias("near"))


_WIDTH = 12
_PIECES = r"regexp_extract_all(text, '[^\p{L}\p{N}_]*[\p{L}\p{N}_][\p{L}\p{N}_\p{Mn}]*')"


@query(f"""with t as (select doc_id, text, {FOLDED} w, {_PIECES} p from documents), h as (select doc_id, unnest(w) term, unnest(range(len(w))) pos from t), g as (select * from h where term in ('nicht', 'que', 'plan', 'that')),
v as (select a.doc_id, a.pos, count(distinct b.term) kinds, count(*) many, max(b.pos) last from g a join g b on a.doc_id = b.doc_id and b.pos between a.pos and a.pos + {_WIDTH - 1} group by all),
b as (select * from v qualify row_number() over (partition by doc_id order by kinds desc, many desc, pos) = 1),
m as (select doc_id, greatest(least(b.pos - ({_WIDTH} - (last - b.pos)) // 2, len(p) - {_WIDTH}), 0) s, p, text, w from b join t using (doc_id)),
k as (select *, array_to_string([case when w[i] in ('nicht', 'que', 'plan', 'that') then regexp_replace(p[i], '([\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_\\p{{Mn}}]*)$', '**\\1**') else p[i] end for i in range(s + 1, least(s + {_WIDTH}, len(p)) + 1)], '') line from m)
select doc_id, case when s > 0 then '...' || regexp_replace(line, '^[^\\p{{L}}\\p{{N}}_*]+', '') else line end || case when s + {_WIDTH} < len(p) then '...' else regexp_extract(text, '[^\\p{{L}}\\p{{N}}_\\p{{Mn}}]*$') end snippet from k""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragment of most of the words for every document that has one of them, hits marked."""
    hits = stored(spark, sf_dir).scored(grammar.parsed("nicht OR que OR plan OR that"), places=True)
    return index.with_fragments(docs(spark, sf_dir).select("doc_id", "text"), hits, _WIDTH).select("doc_id", "snippet")


@query(f"""with d as (select doc_id, case when quality = 0 then text || ' revised plan' else text end t from documents left join labels using (doc_id) where coalesce(toxic, 0) = 0),
t as (select doc_id, regexp_extract_all(strip_accents(lower(t)), '[\\p{{L}}\\p{{N}}_]+') w from d), f as (select doc_id, len(w) l, len(list_filter(w, lambda x: x = 'revised')) f0, len(list_filter(w, lambda x: x = 'the')) f1 from t),
s as (select count(*) n, avg(l) av, count(*) filter (f0 > 0) d0, count(*) filter (f1 > 0) d1 from f)
select doc_id, floor(-(greatest(ln((n - d0 + .5) / (d0 + .5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (.25 + .75 * l / av)) + greatest(ln((n - d1 + .5) / (d1 + .5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (.25 + .75 * l / av))) * 1e6 + 0.5) / 1e6 score from f, s where f0 > 0 or f1 > 0""")
def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written in two parts, then with the documents of low quality replaced and the toxic ones deleted, ranks as one of what is left."""
    d, marks = docs(spark, sf_dir).select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    found = index.Index(spark, f"{scratch_dir(spark)}/lectern-index-{uuid.uuid4().hex}")
    found = found.write(d.where("lang = 'en'")).write(d.where("coalesce(lang, '') != 'en'"))
    revised = d.join(marks.where("quality = 0").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat("text", F.lit(" revised plan")))
    return _shown(found.write(revised).delete(marks.where("toxic = 1").select("doc_id")).scored(grammar.parsed("revised OR the")))


@query("""with a as (select source file, count(*) games, sum(n_chars)::bigint chars from documents group by source), b as (select source file, count(*) games, sum(n_chars)::bigint chars from documents where lang = 'fr' group by source having count(*) >= 8)
select file, coalesce(b.games, a.games) games, coalesce(b.chars, a.chars) chars from a left join b using (file)""")
def summary_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by file put in place of earlier ones in a keyed table."""
    rows = docs(spark, sf_dir).select(F.col("source").alias("file"), "lang", "n_chars")
    summed = lambda d: d.groupBy("file").agg(F.count("*").alias("games"), F.sum("n_chars").alias("chars"))
    path = f"{scratch_dir(spark)}/lectern-keyed-{uuid.uuid4().hex}"
    sinks.upsert(summed(rows), path, "file")
    return sinks.upsert(summed(rows.where("lang = 'fr'")).where("games >= 8"), path, "file")


@query(f"select doc_id, sha256({SQUEEZED}) fp from documents")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.fingerprint(F.col("text")).alias("fp"))


@query(f"select sha256({SQUEEZED}) fp, count(*) copies, min(doc_id) first_id from documents group by 1 having count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", X.fingerprint(F.col("text")).alias("fp"))
    return d.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.substring(X.squeezed(F.col("text")), 1, 100))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), X.fingerprint(F.col("text")).alias("fp"), key.alias("gid"), (F.col("n_chars") % 50).cast("double").alias("evs"))


_VERSIONS = f"select doc_id idx, sha256({SQUEEZED}) fp, md5(left({SQUEEZED}, 100)) gid, (n_chars % 50)::double evs from documents"


@query(f"""with r as ({_VERSIONS}), st as (select sha256({SQUEEZED}) fp, md5(left({SQUEEZED}, 100)) gid, 25.0::double evs from benchmark),
a as (select r.*, p.fp is not null pers, min(case when r.evs > 0 and p.fp is null then r.idx end) over (partition by r.fp) fa from r left join (select distinct fp from st) p on r.fp = p.fp),
b as (select *, pers or coalesce(idx > fa, false) dup, case when not pers and evs > 0 and idx = fa then evs end acc from a),
c as (select b.*, m.mx, max(acc) over (partition by b.gid order by idx rows between unbounded preceding and 1 preceding) rm from b left join (select gid, max(evs) mx from st group by gid) m on b.gid = m.gid)
select idx, case when dup then 'DUPLICATE' when evs > 0 then case when coalesce(mx, rm) is null then 'NEW GAME' when evs > greatest(coalesce(mx, rm), coalesce(rm, mx)) then 'UPGRADE' else 'VERSION' end else 'REJECTED' end status from c""")
def dedup_status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    state = b.select(X.fingerprint(F.col("text")).alias("fp"), F.md5(F.substring(X.squeezed(F.col("text")), 1, 100)).alias("gid"), F.lit(25.0).alias("evs"))
    return corpus.dedup_status(_versions(spark, sf_dir), state).select("idx", "status")


@query(f"with r as ({_VERSIONS}) select idx, gid, evs from r qualify row_number() over (partition by gid order by evs desc, idx) = 1")
def best_version_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.best_version(_versions(spark, sf_dir).select("idx", "gid", "evs"), "gid", "evs", "idx")


@query(f"select doc_id, sha256({SQUEEZED}) in (select sha256({SQUEEZED}) from benchmark) known from documents")
def persisted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the fingerprints of the benchmark, by the filter of the stored state."""
    state = known.Known(spark, f"{scratch_dir(spark)}/lectern-known-{uuid.uuid4().hex}")
    state.append(table(spark, sf_dir, "benchmark").select(X.fingerprint(F.col("text")).alias("fp"), F.lit("").alias("gid"), F.lit(25.0).alias("evs")), "benchmark")
    return state.look_up(docs(spark, sf_dir).select("doc_id", X.fingerprint(F.col("text")).alias("fp"))).rows.select("doc_id", "known")


def _hits_sql(listed: list[str]) -> str:
    return f"len(list_filter(w, lambda x: x in ({', '.join(repr(w) for w in listed)})))"


@query(f"""with t as (select doc_id, text, {WORDS} w from documents), h as (select *, {_hits_sql(X.EN_STOP)} en, {_hits_sql(X.ES_STOP)} es, {_hits_sql(X.DE_STOP)} de from t),
l as (select *, case when en >= es and en >= de then 'en' when es >= de then 'es' else 'de' end top from h)
select doc_id, en::bigint en, es::bigint es, de::bigint de, case when length(trim(text)) >= 30 then array_to_string(list_sort(list_distinct(list_filter([
  case when regexp_matches(lower(text), '[äöüß]') then 'de' end, case when regexp_matches(lower(text), '[áéíóúñ]') then 'es' end, case when greatest(en, es, de) > 3 then top end], lambda x: x is not null))), ',') end langs from l""")
def language_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks, found = X.accents_and_hits(F.col("text"))
    d = docs(spark, sf_dir).select("doc_id", "text", *[found[k].alias(k) for k in ("en", "es", "de")])
    return d.select("doc_id", "en", "es", "de", F.array_join(X.named(F.col("text"), marks, {k: F.col(k) for k in found}), ",").alias("langs"))


@query(f"""with t as (select doc_id, {WORDS} w from documents), c as (select *, list_filter(w, lambda x: x not in ({', '.join(repr(x) for x in sorted({*X.EN_STOP, *X.ES_STOP, *X.DE_STOP}))})) c from t)
select doc_id, len(w)::bigint words, len(c)::bigint content_words, {_ROUND.format('(len(list_distinct(c)) / greatest(len(c), 1)::double)')} unique_ratio,
{_ROUND.format("(case when len(w) > 0 then length(array_to_string(w, '')) / len(w)::double else 0 end)")} avg_len from c""")
def content_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("w"))
    t = t.withColumn("c", F.filter("w", lambda x: ~x.isin(*{*X.EN_STOP, *X.ES_STOP, *X.DE_STOP})))
    n = F.size("w")
    return t.select(
        "doc_id", n.cast("long").alias("words"), F.size("c").cast("long").alias("content_words"), X.rounded(F.size(F.array_distinct("c")) / F.greatest(F.size("c"), F.lit(1))).alias("unique_ratio"),
        X.rounded(F.when(n > 0, F.length(F.array_join("w", "")) / n).otherwise(0.0)).alias("avg_len"),
    )


@query(f"""with t as (select doc_id, lower(text) l, len({WORDS}) n from documents),
s as (select doc_id, n, {' + '.join(f"(length(l) - length(replace(l, '{k.replace('_', ' ')}', ''))) // {len(k)} * {v}" for k, v in sorted(VOCABULARY.items()))} total from t)
select doc_id, {_ROUND.format('v')} vocab_score, v > 50 instructional from (select doc_id, case when n = 0 then 0 else least(total * 1000.0::double / n, 100.0) end v from s)""")
def vocab_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", X.vocabulary_score(F.col("text"), VOCABULARY).alias("v"))
    return d.select("doc_id", X.rounded(F.col("v")).alias("vocab_score"), (F.col("v") > 50).alias("instructional"))


_SEEN: set[str] = set()
_TIER_SQL = " + ".join(f"case when contains(p, ' {w} ') then {v} else 0 end" for v, ws in X.TIERS.items() for w in ws if not (w in _SEEN or _SEEN.add(w)))


@query(f"""with v as (select w term, count(distinct item_id) weight from (select item_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) w from benchmark) group by w),
o as (select doc_id, sum((length(t) - length(replace(t, term, ''))) // length(term) * weight)::bigint total from (select doc_id, lower(text) t from documents) join v on contains(t, term) group by doc_id)
select doc_id, coalesce(total, 0) total, {_ROUND.format("(case when len(w) = 0 then 0 else least(coalesce(total, 0) * 1000.0 / len(w), 100) end)")} score from (select doc_id, {WORDS} w from documents) left join o using (doc_id)""")
def vocab_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary from a table, here the words of the benchmark by how many items have them; all its terms are sought together."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("term"))
    weights = {r.term: r.n for r in words.groupBy("term").agg(F.count_distinct("item_id").alias("n")).collect()}
    d = docs(spark, sf_dir).select("doc_id", X.weighted_occurrences(F.lower("text"), weights).alias("total"), F.size(X.tokens(F.col("text"))).alias("n"))
    return d.select("doc_id", "total", X.rounded(F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.least(F.col("total") * 1000.0 / F.col("n"), F.lit(100.0)))).alias("score"))


@query(f"with t as (select doc_id, ' ' || array_to_string({TERMS}, ' ') || ' ' p from documents) select doc_id, floor(({_TIER_SQL}) * 10 + 0.5)::double / 10 weight from t")
def keyword_tier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.rounded(X.tier_weight(F.col("text")), 1).alias("weight"))


_NOTES = "len(regexp_extract_all(text, '[!?]{1,2}')) + len(regexp_extract_all(text, '\\$[0-9]+'))"


@query(f"select doc_id, ({_NOTES})::bigint notes, len(regexp_extract_all(text, '\\{{([^}}]*)\\}}', 1))::bigint comments, regexp_matches(text, '\\(([^)]*)\\)') has_variations, regexp_matches(text, '\\b(1-0|0-1|1/2-1/2)\\b') has_result from documents")
def annotation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", X.annotation_count(t).alias("notes"), F.size(X.comments(t)).cast("long").alias("comments"), t.rlike(r"\(([^)]*)\)").alias("has_variations"), t.rlike(r"\b(1-0|0-1|1/2-1/2)\b").alias("has_result"))


@query(f"""with t as (select doc_id, text, {WORDS} w, {_NOTES} notes, lang from documents),
f as (select *, greatest(len(w) // 20, 1) plies, len(w) words from t), g as (select *, notes / plies::double density, (len(w) // 7) % 5 * 3 side from f),
p as (select *, least(least(14.0, 12.0) + case when lang = 'en' then 4 else 0 end + least(plies / 40.0::double * 4, 4), 20) structure, least(density * 70, 18) + least(words / 22.0::double, 14) annotations,
  least(6 + 4 + 3 + least(plies / 60.0::double * 5, 5), 20) humanness from g),
e as (select *, structure + annotations + humanness + 25 - case when side / plies::double > 1 and words < 110 then least((side / plies::double - 1) * 10, 10) else 0 end s from p),
h as (select *, least(case when plies < 10 then greatest(greatest(s, 0) - 10, 0) else greatest(s, 0) end, 100) s1, words / plies::double wpm from e),
i as (select *, case when words < 65 and density < 0.22 then least(s1, 79) else s1 end s2 from h)
select doc_id, {_ROUND.format('structure')} structure, {_ROUND.format('annotations')} annotations, {_ROUND.format('humanness')} humanness,
  {_ROUND.format('(case when wpm <= 1.5 or side = 0 and wpm <= 3.5 then 0 when side = 0 then greatest(s2 - 15, 0) else s2 end)')} evs,
  case when wpm <= 1.5 then 'low_density' when side = 0 and wpm <= 3.5 then 'no_variations' when words < 5 then 'database_dump' when density >= 0.2 or words > 150 then 'annotated_game' when plies < 20 then 'position_study' else 'complete_game' end game_type from i""")
def evs_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score's parts and gates over features that documents stand in for: 20 words a ply."""
    words = F.size("w")
    t = docs(spark, sf_dir).select("doc_id", "lang", X.annotation_count(F.col("text")).alias("notes"), X.tokens(F.col("text")).alias("w"))
    t = t.select("doc_id", "lang", "notes", words.alias("words"), F.greatest(F.floor(words / 20), F.lit(1)).cast("long").alias("plies"), (F.floor(words / 7) % 5 * 3).cast("long").alias("side"))
    t = t.withColumn("density", F.col("notes") / F.col("plies"))
    t = t.withColumns({
        "structure": S.structure(F.lit(7), F.col("plies"), F.col("lang") == "en"),
        "annotations": S.annotations(F.col("density"), F.col("words"), F.lit(0.0)),
        "humanness": S.humanness(F.lit(2), F.lit(True), F.lit(1995), F.col("plies")),
    })
    evs, kind, _ = S.score(F.col("structure") + F.col("annotations") + F.col("humanness"), F.lit(0.0), F.col("words"), F.col("density"), F.col("plies"), F.col("side"))
    return t.select("doc_id", *[X.rounded(F.col(c)).alias(c) for c in ("structure", "annotations", "humanness")], X.rounded(evs).alias("evs"), kind.alias("game_type"))


def _summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("source", F.least(F.col("n_chars") / 50.0, F.lit(100.0)).alias("evs"), (F.col("n_chars") % 7 / 10.0).alias("density"), F.col("n_chars").alias("plies"))


@query("""with r as (select source, least(n_chars / 50.0::double, 100) evs, n_chars % 7 / 10.0::double density, n_chars plies from documents)
select source, count(*) games, count(*) filter (evs >= 70) high, count(*) filter (evs >= 45 and evs < 70) medium, count(*) filter (evs < 45) low, floor(avg(evs) * 100 + 0.5) / 100 avg_evs,
floor(quantile_cont(evs, 0.5) * 100 + 0.5) / 100 median_evs, floor(avg(density) * 1000 + 0.5) / 1000 avg_density, floor(avg(plies) * 10 + 0.5) / 10 avg_plies from r group by source""")
def file_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quality_summary(_summary_rows(spark, sf_dir), "source")


@query("with r as (select source, least(n_chars / 50.0::double, 100) evs from documents) select threshold, source, count(*) kept from r, (values (30.0::double), (70.0)) t(threshold) where evs >= threshold group by all")
def threshold_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.kept_at(_summary_rows(spark, sf_dir), corpus.parse_thresholds("30,x,70")).groupBy("threshold", "source").agg(F.count("*").alias("kept"))


@query("with r as (select source, least(n_chars / 50.0::double, 100) evs from documents) select bucket, source, count(*) rows_in from r join (values (20.0::double, 40.0::double, 'thin'), (30.0, 60.0, 'mid')) b(low, high, bucket) on evs between low and high group by all")
def bucket_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.in_buckets(_summary_rows(spark, sf_dir), corpus.parse_buckets(["20-40=thin", "30-60=mid", "bad"])).groupBy("bucket", "source").agg(F.count("*").alias("rows_in"))


@query("select source, count(*) chunks, floor(avg(quality) * 1e6 + 0.5) / 1e6 avg_quality, sum(quality)::bigint instructional from documents join labels using (doc_id) group by source")
def book_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = docs(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("chunks"), X.rounded(F.avg("quality")).alias("avg_quality"), F.sum("quality").cast("long").alias("instructional"))


@query("with r as (select source, lang, row_number() over (partition by source order by doc_id) p from documents) select source, count(distinct lang) langs from r where p <= 10 group by source")
def first_ten_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_rows(docs(spark, sf_dir).select("source", "lang", "doc_id"), "source", "doc_id", 10).groupBy("source").agg(F.countDistinct("lang").alias("langs"))


@query("select source, doc_id from documents qualify row_number() over (partition by source order by doc_id) = 31")
def offset_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_rows(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 1, 30).select("source", "doc_id")


@query("select o_orderkey, coalesce(string_agg(l_linenumber::varchar, ',' order by l_linenumber), '') lines, count(l_linenumber) n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def nested_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested children of every parent, empty where there are none."""
    kids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("k"))
    out = table(spark, sf_dir, "orders").select("o_orderkey").join(kids, "o_orderkey", "left")
    return out.select("o_orderkey", F.coalesce(F.array_join(F.transform("k", lambda x: x.cast("string")), ","), F.lit("")).alias("lines"), F.coalesce(F.size("k"), F.lit(0)).cast("long").alias("n"))


@query("""select page_id, case when contains(u, 'modern chess') or contains(u, 'mcm') then 'modern_chess_course' when contains(u, 'chessable') then 'chessable_course' when contains(u, 'mega') and contains(u, 'database') then 'mega_database'
when contains(u, 'powerbase') then 'powerbase' when contains(u, 'magazine') or contains(u, 'cbm') then 'chessbase_magazine' when contains(u, 'theory') and contains(u, 'update') then 'theory_update' else 'course_material' end source_type
from (select page_id, lower(url) u from pages)""")
def source_type_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.source_type(F.lower("url")).alias("source_type"))


@query("with p as (select *, greatest(n_chars // 60, 1) plies, n_chars len from documents), q as (select *, ceil(plies / 18.0)::bigint parts from p), u as (select *, unnest(range(1, parts + 1)) part, len // parts c from q), "
       "s as (select *, case when part > 1 then greatest((part - 1) * c - c // 10, 0) else 0 end a, case when part < parts then part * c else len end b from u) "
       "select doc_id, part, parts, a::bigint \"start\", b::bigint \"end\", md5(substr(text, a + 1, b - a)) piece, ((part - 1) * 18 + 1) || '-' || least(part * 18, plies) moves, length(substr(text, a + 1, b - a)) // 3 tokens from s")  # fmt: skip
def overlap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "text", F.greatest(F.floor(F.col("n_chars") / 60), F.lit(1)).cast("long").alias("plies"))
    return corpus.overlap_parts(d).select("doc_id", "part", "parts", "start", "end", F.md5("piece").alias("piece"), "moves", F.floor(F.length("piece") / 3).cast("long").alias("tokens"))


@query("""with t as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: length(trim(x))), lambda x: x > 0) l from documents where length(trim(text)) > 0),
f as (select doc_id, len(l) n, list_reduce(list_prepend(0::bigint, list_transform(l, lambda x: x::bigint)), lambda a, x: case when a % 1099511627776 + x >= 2500 then (a // 1099511627776 + 1) * 1099511627776 else a + x end) a from t)
select doc_id, n::bigint elements, (a // 1099511627776 + case when a % 1099511627776 > 0 then 1 else 0 end)::bigint chunks from f""")
def threshold_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document folded into chunks; the state stays inside the row."""
    lens = F.filter(F.transform(F.split("text", "\n"), lambda x: F.length(F.trim(x)).cast("long")), lambda n: n > 0)
    d = docs(spark, sf_dir).where("length(trim(text)) > 0").select("doc_id", lens.alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("elements"), (F.element_at(fold.fold_chunks(F.col("l")), -1) + 1).alias("chunks"))


@query("""with recursive l as (select doc_id, unnest(range(len(x))) line, unnest(x) s from (select doc_id, string_split(text, chr(10)) x from documents)),
e as (select doc_id, line, length(s) n, sum(length(s)) over (partition by doc_id order by line) e from l),
c as (select doc_id, 0 chunk, 0 first, 0::hugeint before from documents union all select c.doc_id, chunk + 1, nxt.line + 1, nxt.e from c, lateral (select line, e from e where e.doc_id = c.doc_id and e.e >= c.before + 2500 order by line limit 1) nxt)
select doc_id, chunk::bigint chunk, count(*) lines, sum(n)::bigint chars from e join lateral (select max(chunk) chunk from c where c.doc_id = e.doc_id and c.first <= e.line) on true group by all""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows, cut into chunks over many tasks."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).select("doc_id", "line", F.length("s").cast("long").alias("n"))
    return fold.fold_rows(lines, "doc_id", "line", "n").groupBy("doc_id", "chunk").agg(F.count("*").alias("lines"), F.sum("n").alias("chars"))


@query("select doc_id, 'Source: ' || upper(source[1]) || source[2:] || ' ▸ Course: ' || lang || case when n_chars > 1000 then ' ▸ Section: long' else '' end breadcrumb from documents")
def breadcrumb_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", corpus.breadcrumb(F.col("source"), ("Course", F.col("lang")), ("Section", F.when(F.col("n_chars") > 1000, "long"))).alias("breadcrumb"))


@query("""with p as (select page_id, regexp_extract(url, '//[^/]*/([a-z]+)', 1) book, regexp_replace(url, '[?#].*$', '') src from pages), s as (select page_id, 'whole' part, book, src from p union all select page_id, 'end', book, right(src, 2) from p),
i as (select book, path, row_number() over (partition by book order by path) o from (select distinct book, regexp_extract(src, '[^/]*$') path from p) where path != ''),
b as (select page_id, part, min(o) o from s join i on i.book = s.book and (suffix(src, path) or suffix(path, src)) group by all)
select page_id, part, case when b.o is null then '/diagrams/' || regexp_extract(src, '[^/]*$') else '/diagrams/' || s.book || '_' || path end image_path from s left join b using (page_id, part) left join i on i.book = s.book and i.o = b.o where src != ''""")
def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages, whole and their last two characters, resolved against the file names of their site's part as images are."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//[^/]*/([a-z]+)", 1).alias("book"), F.regexp_replace("url", "[?#].*$", "").alias("src"))
    images = p.select("book", F.regexp_extract("src", "[^/]*$", 0).alias("package_path")).distinct().where("package_path <> ''")
    images = images.withColumns({"ordinal": F.row_number().over(W.partitionBy("book").orderBy("package_path")), "web_path": F.concat(F.lit("/diagrams/"), "book", F.lit("_"), "package_path")})
    asked = p.withColumn("part", F.lit("whole")).unionByName(p.withColumn("part", F.lit("end")).withColumn("src", F.expr("right(src, 2)")))
    return books.image_paths(asked, images).where("src <> ''").select("page_id", "part", "image_path")


@query(f"select md5(sha256({SQUEEZED})) marker, min(doc_id) diagram_id, min_by(source, doc_id) image_path from documents group by 1")
def first_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of all diagrams of one position, with a key; documents stand in for diagrams and their text's fingerprint for the position."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("diagram_id"), F.col("source").alias("image_path"), X.fingerprint(F.col("text")).alias("fen"))
    return books.first_by_position(d, "diagram_id").select("marker", "diagram_id", "image_path")


@query("""with p as (select *, greatest(ceil(greatest(n_chars // 60, 1) / 18.0), 1)::bigint parts, length(text) len from documents),
c as (select parts, part, len // parts c, len from p, lateral (select unnest(range(1, parts + 1)) part)), t as (select *, (case when part < parts then part * c else len end - case when part > 1 then greatest((part - 1) * c - c // 10, 0) else 0 end) // 3 tok from c)
select (select count(distinct source) from documents) files, (select count(text) from documents) games_processed, (select count(*) from documents where text is null) games_failed, count(*) filter (parts > 1 and part = 1) games_split, count(*) chunks, sum(tok)::bigint tokens, sum(tok)::bigint * 0.02::double / 1e6 cost from t""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over all documents read, split and made, and what its tokens cost."""
    d = docs(spark, sf_dir).select("doc_id", F.col("source").alias("file"), "text", F.greatest(F.floor(F.col("n_chars") / 60), F.lit(1)).cast("long").alias("plies"))
    made = corpus.overlap_parts(d).select(F.when(F.col("parts") > 1, F.col("part")).alias("part_num"), chunks.token_estimate(F.col("piece")).alias("token_estimate"))
    return chunks.statistics(d, made)


@query("""with t as (select conv_id, turn, role, string_split(trim(text), ' ') pv from conversations), v as (select conv_id, turn + 2 turn, pv[1] uci from t)
select conv_id game, turn ply, pv[1] uci, 142 nag, array_to_string(pv[1:6], ' ') line from t where not exists (select 1 from v where v.conv_id = t.conv_id and v.turn = t.turn and v.uci = t.pv[1])""")
def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not there yet: a turn's words are its line, the one two turns before is the variation that may be there."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("game"), F.col("turn").alias("ply"), F.split(F.trim("text"), " ").alias("pv"))
    there = t.select("game", (F.col("ply") + 2).alias("ply"), F.col("pv")[0].alias("uci"))
    return positions.better_lines(t, there).select("game", "ply", "uci", "nag", F.array_join("line", " ").alias("line"))


@query("select page_id, len(regexp_extract_all(html, '<p[ >]'))::bigint paragraphs, len(regexp_extract_all(html, '<h[1-3][ >]'))::bigint headings, len(regexp_extract_all(html, '<img[ >]'))::bigint images, regexp_extract(html, '<title>([^<]*)', 1) title from pages")
def html_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<p[ >]").alias("paragraphs"), n("<h[1-3][ >]").alias("headings"), n("<img[ >]").alias("images"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))


@query()
def html_element_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and images of every page in order; a tree walk, so without SQL."""
    return markup.html_elements(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""with a as (select doc_id, regexp_replace(text, '\\d+\\.+\\s*[a-hNBRQKO][a-h0-9x+#=]*\\s*\\$\\d+', '', 'g') t from documents), b as (select doc_id, regexp_replace(t, '\\$\\d+', '', 'g') t from a),
c as (select doc_id, regexp_replace(regexp_replace(t, '\\([^)]*\\)', ' ', 'g'), '\\{[^}]*\\}', ' ', 'g') t from b), d as (select doc_id, regexp_replace(t, '(\\d+\\.+\\s*[a-hNBRQKO][^ \\n]*\\s*){3,}', ' [moves... ] ', 'g') t from c),
e as (select doc_id, regexp_replace(t, '\\s+', ' ', 'g') t from d) select doc_id, trim(case when length(t) > 300 then left(t, 300) || '...' else t end) caption from e""")
def caption_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.clean_caption(F.col("text")).alias("caption"))


@query("""with e as (select user_id, event_id, ts, case when event_id % 2 = 0 then 'white' else 'black' end side, floor(value * 10)::bigint cp from events),
l as (select *, lag(cp) over (partition by user_id order by ts, event_id) b from e), d as (select *, case when side = 'white' then b - cp else cp - b end / 100.0::double dr from l)
select event_id, floor(dr * 1e6 + 0.5) / 1e6 "drop", case when dr > 0.75 then 4 when dr > 0.3 then 2 end move_nag,
case when cp > 200 then 18 when cp < -200 then 19 when cp > 100 then 16 when cp < -100 then 17 when cp > 50 then 14 when cp < -50 then 15 else 11 end position_nag from d""")
def eval_drop_nag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", F.when(F.col("event_id") % 2 == 0, "white").otherwise("black").alias("side"), F.floor(F.col("value") * 10).cast("long").alias("cp"), F.lit(None).cast("int").alias("mate"))
    return games.evaluation_chain(e, "user_id", "at").select("event_id", X.rounded(F.col("drop")).alias("drop"), "move_nag", "position_nag")


@query("""with m as (select conv_id, turn, 'D' || (turn % 3) marker from conversations where role = 'assistant'), d as (select * from (values ('D0', 'first'), ('D1', 'second')) v(marker, diagram))
select conv_id, turn, marker, coalesce(diagram, 'missing') diagram from m left join d using (marker)""")
def diagram_marker_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of answers joined to known diagrams, missing ones flagged."""
    text = F.concat(F.lit("see [DIAGRAM_ID:D"), (F.col("turn") % 3).cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", text.alias("text"))
    known = spark.createDataFrame([("D0", "first"), ("D1", "second")], "marker string, diagram string")
    return books.marked_diagrams(answers, known).select("conv_id", "turn", "marker", "diagram")


@query("select * from (values (1, 'p', 'r', 'https://lichess.org/analysis/rnbqkbnr/pp1ppppp/8/2p5/4P3/8/PPPP1PPP/RNBQKBNR%20w%20KQkq%20-%200%202'), (2, '.', 'r', 'https://lichess.org/analysis/rnbqkbnr/pppp1ppp/4p3/8/4P3/8/PPPP1PPP/RNBQKBNR%20w%20KQkq%20-%200%202'), (3, '.', '.', 'https://lichess.org/analysis/8/8/8/8/8/8/8/K1k5%20w%20-%20-%200%201')) v(id, c5, a8, url)")
def position_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FENs found in prose, validated, with squares and links."""
    rows = spark.createDataFrame([(i, f"Look at {f} here.") for i, f in FENS], "id int, text string")
    found = rows.select("id", F.explode(games.fens(F.col("text"))).alias("fen")).where(games.canonical(F.col("fen")) == F.col("fen"))
    return found.select("id", games.cell(F.col("fen"), "c5").alias("c5"), games.cell(F.col("fen"), "a8").alias("a8"), games.analysis_url(F.col("fen")).alias("url"))


@query("""select * from (values (1, 'Club Training', '2000', 6, 1, 'b5e68ce9d1a99d0b89a6e224797ceff6', 16.6::double, 12.439394::double, 13.5::double, 7.5::double, 65.039394::double, 'position_study', 'medium'),
(2, 'Chessable Course', 'Unknown', 4, 0, md5('d2d4d7d5c2c4e7e6'), 12.4, floor((18 + 5 / 22.0::double) * 1e6 + 0.5) / 1e6, 4.333333, 0.0, 0.0, 'low_density', 'low')) v(game_no, event, white_elo, plies, variation_plies, game_id, structure, annotations, humanness, educational, evs, game_type, tier)""")
def score_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splitting, headers, move replay, identity and scores of two games; expected values worked out by hand."""
    text = spark.createDataFrame([(GAME_ONE + "\n\n" + GAME_TWO,)], "text string")
    rows = text.select(F.posexplode(pgn.split(F.col("text"))).alias("n", "raw")).select((F.col("n") + 1).alias("game_no"), "raw")
    g = games.scored(rows)
    return g.select(
        "game_no", pgn.header(F.col("raw"), "Event").alias("event"), pgn.header(F.col("raw"), "WhiteElo").alias("white_elo"), F.col("plies").cast("int").alias("plies"), F.col("variation_plies").cast("int").alias("variation_plies"), "game_id",
        *[X.rounded(F.col(c)).alias(c) for c in ("structure", "annotations", "humanness", "educational", "evs")], "game_type", "tier",
    )


@query("select * from (values (1, 'r1bqkbnr/pppp1ppp/2n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQK2R b KQkq - 3 3'), (2, null), (3, 'rnbqkbnr/ppp1pppp/8/3p4/3P4/8/PPP1PPPP/RNBQKBNR w KQkq - 0 2')) v(id, fen)")
def moves_to_fen(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["After 1. e4 e5 2. Nf3 Nc6 3. Bb5 White presses.", "12... Nf6 only", "1.d4 {solid} d5 (1... Nf6) 1-0 2. c4"]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string")
    return rows.select("id", games.fen_after(F.col("text")).alias("fen"))


@query("""select * from (values (1, 'club_game_1', 'Source: Course Material ▸ Course: Club Training ▸ Chapter: A ▸ Section: B ▸ Role: Model Game', 'Game: A (2000) vs B (1900) | Date: 1995.05.01 | Result: 1-0 | Content: annotated, variations', null),
(2, 'club_game_2', 'Source: Chessable Course ▸ Course: Chessable Course ▸ Role: Introduction', 'Date: ????.??.?? | Result: * | Content: annotated', null)) v(id, chunk_id, breadcrumb, summary, part_num)""")
def game_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("/in/club.pgn", 1, GAME_ONE), ("/in/club.pgn", 2, GAME_TWO)], pgn.GAMES)
    lines = F.split("text", "\n")
    return chunks.chunked(rows).select(F.col("game_number").cast("int").alias("id"), "chunk_id", lines[0].alias("breadcrumb"), lines[2].alias("summary"), F.col("part_num").cast("int").alias("part_num"))


@query()
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = books.fold_pages(table(spark, sf_dir, "pages").withColumnRenamed("page_id", "book"), "book", "html")
    return books.chunk_table(folded, VOCABULARY)


@query()
def text_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in texts that are made of a line of moves for each document, cut at a length that its number gives."""
    line = "Then 1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7 ends it."
    made = docs(spark, sf_dir).select("doc_id", F.concat(F.substring("text", 1, 20), F.lit(" "), F.substring(F.lit(line), F.lit(1), (F.col("doc_id") % 40 + 12).cast("int"))).alias("text"))
    return positions.positions(made, "doc_id").select("doc_id", "place", "fen", "type", "moves_parsed", "url")


@query("""select doc_id, list_transform(regexp_extract_all(text, '((?:\\d{1,3}(?:\\.\\.\\.|\\.)\\s*)?[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:\\=[QRBN])?[\\+#]?|O-O(?:-O)?)', 1),
lambda m: regexp_replace(m, '^\\d+(\\.\\.\\.|\\.)\\s*', '')) moves from documents""")
def prose_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", positions.moves_in(F.col("text")).alias("moves"))


@query("""select * from (values (1, ['rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1', 'rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2']), (2, []::varchar[]), (3, null)) v(id, fens)""")
def san_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    rows = spark.createDataFrame([(1, start, ["e4", "e5", "Ke3", "Nf3"]), (2, start, ["Qh5"]), (3, "no position", ["e4"])], "id int, fen string, moves array<string>")
    return rows.select("id", positions.replayed(F.col("fen"), F.col("moves")).alias("fens"))


@query("""with e as (select user_id, event_id, case when event_id % 2 = 0 then 'white' else 'black' end side, floor(value * 10)::bigint cp, ts from events),
d as (select *, lag(cp) over (partition by user_id order by ts, event_id) before from e), j as (select *, case when side = 'white' then before - cp else cp - before end / 100.0::double dropped from d)
select event_id, case when dropped > 0.75 then 4 else 2 end move_nag from j where dropped > 0.3 and side = 'white'""")
def judged_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_id") % 2 == 0, "white").otherwise("black")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), side.alias("side"), F.floor(F.col("value") * 10).alias("cp"), F.lit(None).cast("int").alias("mate"))
    return positions.judged(games.evaluation_chain(rows, "user_id", "at"), side="white").select("event_id", "move_nag")


@query("with r as (" + _VERSIONS + """), s as (select fp, min(idx) filter (evs > 0) first from r where fp not in (select sha256(""" + SQUEEZED + """) from benchmark) group by fp)
select count(*) filter (idx = first) accepted, count(*) filter (first is null or idx <> first) rejected, count(*) filter (idx = first) * 100.0::double / count(*) percent from r left join s using (fp)""")
def acceptance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.acceptance(dedup_status_machine(spark, sf_dir))


@query("select 1 id, '1. d4 $11 d5 $11 2. c4 $1 $2 $11 { Better was g1f3 [%dia] } ( 2. Nf3 $142 ) 2... e6 $11 { Stockfish says +1.23 depth 20 } *' moves")
def annotated_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, GAME_TWO)], "game int, raw string")
    evals = [(1, 0, 20, None), (1, 1, 20, None), (1, 2, 20, ["g1f3"]), (1, 3, -30, None), (1, 4, -20, None)]
    evals = spark.createDataFrame([(g, p, cp, None, pv) for g, p, cp, pv in evals], "game int, ply int, cp int, mate int, pv array<string>")
    moves = F.replace(F.element_at(F.split("annotated", "\n\n"), -1), F.lit("\n"), F.lit(" "))
    return coach.annotate(rows, evals).select(F.col("game").alias("id"), moves.alias("moves"))


@query("select doc_id, case when length(text) > 140 then left(text, 140) || '...' else text end preview, regexp_matches(lower(text), 'rate limit|error') failed from documents")
def answer_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", search.preview(F.col("text"), 140).alias("preview"), search.failed_answer(F.col("text")).alias("failed"))
