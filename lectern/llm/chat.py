"""Preference formatting with DataFrame functions only.

Chosen and rejected conversations of a pair are compared turn by turn; the longest common prefix is rendered once
as the prompt, and what follows on each side is a completion with a mask of the spans that are trained on:
the texts and end marks of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END + "\n"))


def rendered(turns: Column) -> Column:
    """The turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Trained spans ``start:end`` in characters of the rendered completion, separated by commas."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        span = F.concat(F.when(acc["spans"] == "", F.lit("")).otherwise(F.lit(",")), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["spans"], F.when(t["role"] == TRAINED, span).otherwise(F.lit(""))).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, one row for each pair_id.

    ``turns`` has pair_id, side (``chosen`` or ``rejected``), turn, role, text. Turns are ordered by turn (nulls first), then
    role, then text. Null role: ``user``; null text: empty. A side without turns has an empty prompt and completion;
    equal sides are all prompt. Rows without pair_id or of another side belong to no pair; repeated rows are turns.
    Other columns are ignored; an empty table gives no rows. One shuffle, by pair_id; a pair is as large as its output.
    """
    one = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sides = turns.where("pair_id is not null and side in ('chosen', 'rejected')").groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "chosen", one)), lambda x, y: _order(x, y)).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "rejected", one)), lambda x, y: _order(x, y)).alias("r"),
    )
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    both = sides.withColumn("k", F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int"))
    rest = both.select("pair_id", "k", F.slice("c", F.lit(1), F.col("k")).alias("p"), F.slice("c", F.col("k") + 1, F.greatest(F.size("c") - F.col("k"), F.lit(0))).alias("c"), F.slice("r", F.col("k") + 1, F.greatest(F.size("r") - F.col("k"), F.lit(0))).alias("r"))
    return rest.select(
        "pair_id", F.col("k").cast("long").alias("prompt_turns"), rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask")
    )


def _order(x: Column, y: Column) -> Column:
    def by(name: str, then: Column) -> Column:
        a, b = x[name], y[name]
        return F.when(a.isNull() & b.isNull(), then).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(then)

    return by("turn", by("role", by("text", F.lit(0))))


def truncated_replies(conversations: DataFrame) -> DataFrame:
    """A pair from each conversation (conv_id, turn, role, text): it as far as its last assistant turn against the same with half of that reply.

    A conversation without an assistant turn is paired with itself. Ties in turn number: the last by role, then text.
    """
    c = conversations.select(F.col("conv_id").alias("pair_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("pair_id is not null")
    order = W.partitionBy("pair_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    c = c.withColumn("pos", F.row_number().over(order))
    c = c.withColumn("last", F.max(F.when(F.col("role") == TRAINED, F.col("pos"))).over(W.partitionBy("pair_id")))
    c = c.where("last is null or pos <= last").select("*", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side"))
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return c.select("pair_id", "side", F.col("pos").alias("turn"), "role", F.when((F.col("side") == "rejected") & (F.col("pos") == F.col("last")), half).otherwise(F.col("text")).alias("text"))


ORACLE = """
with c as (select conv_id pair_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'user'), coalesce(text, '')) pos,
    coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null),
l as (select *, max(case when role = 'assistant' then pos end) over (partition by pair_id) last from c),
k as (select *, case when pos = last then substr(text, 1, length(text) // 2) else text end other from l where last is null or pos <= last),
m as (select *, coalesce(min(case when text <> other then pos end) over (partition by pair_id), max(pos) over (partition by pair_id) + 1) cut from k),
r as (select *, '<|im_start|>' || role || chr(10) h, text || '<|im_end|>' || chr(10) b, other || '<|im_end|>' || chr(10) o from m),
s as (select *, coalesce(sum(case when pos >= cut then length(h) + length(b) end) over w, 0) - length(h) - length(b) c0,
    coalesce(sum(case when pos >= cut then length(h) + length(o) end) over w, 0) - length(h) - length(o) r0
    from r window w as (partition by pair_id order by pos rows unbounded preceding))
select pair_id, (min(cut) - 1)::bigint prompt_turns, coalesce(string_agg(h || b, '' order by pos) filter (pos < cut), '') prompt,
    coalesce(string_agg(h || b, '' order by pos) filter (pos >= cut), '') chosen, coalesce(string_agg(h || o, '' order by pos) filter (pos >= cut), '') rejected,
    coalesce(string_agg((c0 + length(h))::bigint || ':' || (c0 + length(h) + length(b))::bigint, ',' order by pos) filter (pos >= cut and role = 'assistant'), '') chosen_mask,
    coalesce(string_agg((r0 + length(h))::bigint || ':' || (r0 + length(h) + length(o))::bigint, ',' order by pos) filter (pos >= cut and role = 'assistant'), '') rejected_mask
from s group by pair_id
"""
