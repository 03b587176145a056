"""Preference formatting of chosen and rejected conversations. DataFrame functions only.

The longest run of turns that both conversations begin with, role and text alike, is rendered
once as the prompt. What follows in each is its completion, with the spans (character offsets in
the completion) of the turns that are trained on: the contents of the assistant's turns and their
end marks. All else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
_OPEN, _CLOSE, _END = "<|", "|>\n", "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(_OPEN), turn["role"], F.lit(_CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(_END))), "")


def _trained_spans(turns: Column) -> Column:
    """(first, end) offsets in the rendered turns; one pass that carries the offset."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        first = done["at"] + F.length(_header(turn))
        end = first + F.length(turn["text"]) + F.lit(len(_END))
        more = F.array(F.struct(first.alias("first"), end.alias("end")))
        spans = F.when(turn["role"] == TRAINED_ROLE, F.concat(done["spans"], more)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the turns of each conversation in order.

    Turns go by number, nulls first; equal numbers by role and text. Rows that agree in all four
    columns count once. Null roles and texts become empty. A conversation is one training
    example, so its turns are gathered in one row; conversations without an id are left out.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def preferences(pairs: DataFrame, conversations: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, shared_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    `pairs` has chosen_id and rejected_id; repeated pairs count once, pairs of a conversation with
    itself and pairs without both conversations are left out. Conversations that differ in no turn
    of the shorter one give an empty completion there. A conversation in very many pairs is
    joined, not gathered.
    """
    turns = conversation_turns(conversations)
    wanted = pairs.select(F.col("chosen_id").cast("bigint").alias("chosen_id"), F.col("rejected_id").cast("bigint").alias("rejected_id"))
    joined = (
        wanted.filter("chosen_id <> rejected_id")
        .distinct()
        .join(turns.toDF("chosen_id", "c"), "chosen_id")
        .join(turns.toDF("rejected_id", "r"), "rejected_id")
    )
    return _formatted(joined)


def _formatted(joined: DataFrame) -> DataFrame:
    both = F.zip_with(
        "c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    # The first turn that differs; one is put behind the last for equal beginnings.
    shared = F.array_position(F.concat(both, F.array(F.lit(False))), False).cast("int") - 1
    cut = joined.withColumn("shared_turns", shared)
    rest = lambda side: F.slice(side, F.col("shared_turns") + 1, F.size(side))
    parts = cut.select(
        "chosen_id", "rejected_id", "shared_turns",
        F.slice("c", F.lit(1), F.col("shared_turns")).alias("p"), rest("c").alias("c"), rest("r").alias("r"),
    )
    return parts.select(
        "chosen_id", "rejected_id", "shared_turns",
        _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _trained_spans(F.col("c")).alias("chosen_spans"), _trained_spans(F.col("r")).alias("rejected_spans"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """chosen_id, rejected_id of a table without judgements: ids 2k and 2k + 1, the even one chosen."""
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("id")).filter("id is not null")
    halves = ids.groupBy(F.shiftright("id", 1).alias("pair")).agg(F.min("id").alias("chosen_id"), F.max("id").alias("rejected_id"))
    return halves.filter("chosen_id < rejected_id").select("chosen_id", "rejected_id")
