"""Preference formatting with DataFrame operations only.

A pair has a chosen and a rejected conversation.  Their longest common prefix of
turns (same role and text) is rendered once, as the prompt; what follows in
either is its completion, with the spans of what is trained on: the content and
end mark of its assistant turns.  Spans are code points of the completion, ends
exclusive.

A null role or text counts as empty.  Turns go by number, nulls first, ties by
role and text, and repeated turns stay.  If one conversation is a prefix of the
other, or they are equal, its completion is empty and has no spans.  A null
conversation counts as one without turns.  Repeated pairs give repeated rows, an
empty table an empty one; texts are rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import unused

# How a turn is rendered.
OPEN, HEAD_END, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): an array of (role, text) for each conversation."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return turns.groupBy(F.col(conv)).agg(F.array_sort(F.collect_list(one)).alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the start of both."""
    n = F.least(F.size(a), F.size(b))
    apart = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(apart == 0, n).otherwise(apart - 1)


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(HEAD_END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def trained_spans(turns: Column) -> Column:
    """(start, end) of the assistant turns' content and end marks in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(CLOSE)
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(s["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


OUTPUTS = ("n_prompt_turns", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace two columns of turns by ``OUTPUTS``; other columns of those names are replaced too."""
    keep = [F.col(f"`{c}`") for c in pairs.columns if c not in (chosen, rejected) and c.lower() not in OUTPUTS]
    none = F.array().cast("array<struct<role:string,text:string>>")
    a, b = (F.coalesce(F.col(c), none) for c in (chosen, rejected))
    names = unused(pairs, "n", "a", "b")
    n, first, second = map(F.col, names)
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c), F.lit(1)))
    return (
        pairs.withColumn(names[0], common_turns(a, b))
        .withColumns({names[1]: rest(a), names[2]: rest(b)})
        .select(
            *keep,
            n.cast("long").alias("n_prompt_turns"),
            render(F.slice(a, F.lit(1), n)).alias("prompt"),
            render(first).alias("chosen_text"),
            trained_spans(first).alias("chosen_spans"),
            render(second).alias("rejected_text"),
            trained_spans(second).alias("rejected_spans"),
        )
    )


def pair(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", **columns: str) -> DataFrame:
    """Formatted pairs of two tables of turns that share ``key``; keys of only one table have no pair, null keys match."""
    a = conversations(chosen, key, **columns).select(F.col(key).alias("k"), F.col("turns").alias("chosen"))
    b = conversations(rejected, key, **columns).select(F.col(key).alias("other"), F.col("turns").alias("rejected"))
    return format_pairs(a.join(b, F.col("k").eqNullSafe(F.col("other"))).drop("other")).withColumnRenamed("k", key)


def curt(turns: Column) -> Column:
    """The conversation with its last assistant turn cut after the first sentence: a worse answer to the same prompt."""
    last = F.aggregate(turns, F.struct(F.lit(0).alias("i"), F.lit(0).alias("last")), lambda s, t: F.struct((s["i"] + 1).alias("i"), F.when(t["role"] == TRAINED, s["i"] + 1).otherwise(s["last"]).alias("last")), lambda s: s["last"])
    short = lambda t: F.concat(F.substring_index(t["text"], ".", 1), F.lit("."))
    return F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == last, short(t)).otherwise(t["text"]).alias("text")))
