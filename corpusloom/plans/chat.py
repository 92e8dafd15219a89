"""ChatML prompts of conversations kept as one row per turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.chat import ASSISTANT_OPENER, chatml_turn


def _parts(turns: DataFrame) -> DataFrame:
    """One row per rendered turn; turns with other roles have no part, turns without text an empty one."""
    part = chatml_turn(F.col("role"), F.coalesce(F.col("text"), F.lit("")))
    return turns.select("conv_id", "turn", part.alias("part"))


def _joined(ordered) -> Column:
    return F.array_join(F.transform(F.array_sort(ordered), lambda r: r["part"]), "\n")


def render_conversations(turns: DataFrame) -> DataFrame:
    """`conv_id, text`: one prompt per conversation, which ends by opening the assistant's answer.

    One pass over the table. A row holds a whole conversation, as its prompt does; for conversations too long for a row
    there is `render_chunks`.
    """
    # a null part is skipped by the aggregate, but its conversation is not
    kept = F.when(F.col("part").isNotNull(), F.struct("turn", "part"))
    body = _joined(F.collect_list(kept))
    return _parts(turns).groupBy("conv_id").agg(body.alias("body")).select(
        "conv_id", F.concat(F.when(F.col("body") != "", F.concat("body", F.lit("\n"))).otherwise(""), F.lit(ASSISTANT_OPENER))
        .alias("text"),
    )


def render_chunks(turns: DataFrame, turns_per_row: int) -> DataFrame:
    """`conv_id, chunk, text` with `turns_per_row` values of `turn` in a row: the prompt in parts, for conversations of any length.

    Joining a conversation's chunks with a newline and appending the opener gives its prompt.
    """
    chunk = F.floor(F.col("turn") / F.lit(turns_per_row))
    rows = _parts(turns).where(F.col("part").isNotNull())
    return rows.groupBy("conv_id", chunk.alias("chunk")).agg(_joined(F.collect_list(F.struct("turn", "part"))).alias("text"))
