"""Chat formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn (fixed values of the ChatML format), and what they begin with.
BEGIN, END = "<|im_start|>", "<|im_end|>"
MARK, DEFUSED = "<|im_", "<| im_"


def _plain(said: Column | str) -> Column:
    """What was said, null as empty, with no mark in it."""
    return F.replace(F.coalesce(said, F.lit("")), F.lit(MARK), F.lit(DEFUSED))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """[begin, end) characters of the completion to learn from: assistants' texts with their end marks."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(a: Column, turn: Column) -> Column:
        begin = a["at"] + len(BEGIN) + F.length(turn["role"]) + 1
        end = begin + F.length(turn["text"]) + len(END)
        spans = F.when(turn["role"] == "assistant", F.concat(a["spans"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(a["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def preference_rows(turns: DataFrame, pair: Column, is_chosen: Column) -> DataFrame:
    """One row a ``pair``: pair_id, n_prompt_turns, prompt, chosen, rejected and the spans to learn from in each.

    ``turns`` (conv_id, turn, role, text) holds both conversations of each pair; ``is_chosen`` tells them apart.
    Turns are ordered by (turn, role, text), nulls first; null roles and texts are rendered empty. Marks inside roles
    and texts are rendered with a blank (``<| im_``), so that nothing said can forge a turn. Texts of any length are
    rendered whole. The prompt is
    the longest run of leading turns that both have in equal role and text, rendered once; what follows it is a
    completion. Where one side is missing the prompt is empty and its completion is empty; of equal conversations
    both completions are. Repeated turns are turns like others. Rows whose ``pair`` or side is null belong to no
    pair and give no row. An empty table gives an empty table. A pair is gathered in one row, as it is returned;
    pairs of different ids never share a task's memory.
    """
    clean = turns.select(
        pair.alias("pair_id"), is_chosen.alias("_side"), F.struct(F.col("turn"), _plain("role").alias("role"), _plain("text").alias("text")).alias("t")
    ).filter("pair_id is not null and _side is not null")
    side = lambda which: F.sort_array(F.collect_list(F.when(F.col("_side") == which, F.col("t"))))
    rows = clean.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    both = F.least(F.size("c"), F.size("r"))
    differs = F.transform(F.arrays_zip("c", "r"), lambda x: (x["c"]["role"] != x["r"]["role"]) | (x["c"]["text"] != x["r"]["text"]))
    first = F.array_position(F.slice(differs, F.lit(1), both), True)
    rows = rows.withColumn("n", F.when(first > 0, first - 1).otherwise(both).cast("int"))
    rest = lambda x: F.slice(F.col(x), F.col("n") + 1, F.size(x))
    return rows.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("c")).alias("chosen"),
        _render(rest("r")).alias("rejected"),
        _mask(rest("c")).alias("chosen_spans"),
        _mask(rest("r")).alias("rejected_spans"),
    )
