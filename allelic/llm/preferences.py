"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def spans(turns: Column, role: str) -> Column:
    """[begin, end) in characters of what is trained on: the text of the role's turns with its end mark."""
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(CLOSE)
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def add(acc, t):
        begin = acc["at"] + head(t)
        end = begin + F.length(t["text"]) + len(END)
        own = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add)["spans"]


def format_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row for each pair_id of ``turns`` (pair_id, chosen boolean, turn, role, text).

    Returns pair_id, prefix_turns (leading turns that both conversations share, by role and text),
    prompt (those turns, rendered once), chosen and rejected (the other
    turns of either), chosen_spans and rejected_spans (arrays of [begin, end) in
    characters of the completion where the loss counts: what ``trained`` says).

    Turns are ordered by turn, then role and text; gaps and repeats in turn numbers don't
    matter. Null role and text count as empty. A conversation without a partner shares nothing and
    has an empty other side; two equal ones leave two empty completions. Rows with a
    null pair_id or chosen are left out. An empty table gives an empty result. Other columns are ignored.

    One shuffle by pair; a task holds one conversation pair at a time, as long as the row it makes.
    """
    told = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda own: F.transform(F.array_sort(F.collect_list(F.when(own, told))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = turns.filter("pair_id is not null and chosen is not null").groupBy("pair_id").agg(side(F.col("chosen")).alias("c"), side(~F.col("chosen")).alias("r"))
    first = F.array_position(F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a.eqNullSafe(b)), False)
    both = both.withColumn("prefix_turns", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("prefix_turns") + 1, F.size(c))
    both = both.select("pair_id", "prefix_turns", F.slice("c", F.lit(1), F.col("prefix_turns")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select("pair_id", "prefix_turns", joined(F.col("p")).alias("prompt"), joined(F.col("c")).alias("chosen"), joined(F.col("r")).alias("rejected"), spans(F.col("c"), trained).alias("chosen_spans"), spans(F.col("r"), trained).alias("rejected_spans"))
