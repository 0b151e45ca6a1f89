"""Chat formatting by rotating the perspective: each participant in turn is the assistant, the others are named users.

Every (participant, turn) gives one row: the rendered turn, its place in the rendered dialogue, and the span to be
learned from (content and end mark of the assistant's own turns). Speakers in ``narrators`` are no participants; their
turns are system turns in every perspective. Joining a perspective's ``rendered`` in order of ``char_start`` gives the
dialogue; as rows, a dialogue of any length spreads over tasks: places come from sums over blocks of turns.

Defined results: turns go by (turn, speaker, text), null turns first; equal rows follow each other. A null speaker is
named ``unknown``, null text is empty. A conversation with narrators only has no row. Null conversation ids are one
conversation. An empty table gives an empty table. Columns other than those named are not read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 4096


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, turn, role, speaker, rendered, char_start, char_end, loss_start, loss_end)."""
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col(turn_col) / BLOCK), F.lit(-(1 << 62))).cast("long").alias("block"),
    )
    people = said.where(~F.col("speaker").isin(*narrators)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    role = F.when(F.col("speaker").isin(*narrators), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("role", role)
    name = F.regexp_replace("speaker", "[^A-Za-z0-9_-]", "_")
    head = F.concat(F.lit(START), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    seen = seen.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, "text", F.lit(END + "\n"))).withColumn("size", F.length("rendered").cast("long"))
    blocks = seen.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("block_size"))
    over = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "perspective", "block", F.coalesce(F.sum("block_size").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.withColumn("upto", F.sum("size").over(within)).alias("t")
    same = " and ".join(f"t.{c} <=> b.{c}" for c in ("conv_id", "perspective", "block"))
    end = F.col("before") + F.col("upto")
    start = end - F.col("size")
    own = F.col("role") == "assistant"
    return placed.join(blocks.alias("b"), F.expr(same)).select(
        "t.conv_id", "t.perspective", "turn", "role", "speaker", "rendered",
        start.alias("char_start"), end.alias("char_end"),
        F.when(own, start + F.col("head")).alias("loss_start"), F.when(own, end - 1).alias("loss_end"),
    )
