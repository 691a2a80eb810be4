"""Dialogues rendered once per participant, in DataFrame functions only.

From each speaker's perspective the speaker is the assistant, everybody else a named user, and
the loss mask covers what the assistant says. Turns are range-sorted once; offsets are running
sums per sorted piece plus what earlier pieces of the dialogue hold, so a dialogue of any length
is spread over tasks. Rendered text comes in chunks of bounded size with offsets that run on.

Defined cases: a NULL role speaks as ``unknown``; a NULL text is empty; equal turn numbers go by
role, then text; repeated turns are kept; a dialogue in which only narrators speak has no
perspective; a NULL dialogue id is a dialogue of its own; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import carried, ordered

NARRATORS = ("system",)
CHUNK = 1 << 16
OWN = "<|assistant|>\n"
STOP = "<|end|>\n"


def _named(role: Column) -> Column:
    return F.concat(F.lit("<|user "), role, F.lit("|>\n"))


def rotate(
    turns: DataFrame,
    dialogue: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    narrators: Sequence[str] = NARRATORS,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per dialogue, perspective and chunk.

    ``start`` is the chunk's offset in the rendered dialogue in code points; a turn lies whole
    in the chunk where it starts. ``masks`` are the trained ranges, in offsets of the dialogue:
    the speaker's own text with the stop mark.
    """
    plain = turns.select(
        F.col(dialogue).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # A cheap projection of a scan: not worth a copy before the sort.
    rows = ordered(plain, ["conv_id", "turn", "role", "text"], "chat", staged=False)
    narrated = F.col("role").isin(*narrators)
    header = F.when(narrated, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise(
        _named(F.col("role"))
    )
    rows = rows.withColumn("_header", header).withColumn(
        "_size", (F.length("_header") + F.length("text") + len(STOP)).cast("long")
    )
    rows = carried(rows, ["conv_id"], F.col("_size"), "_size_before")
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    here = before.partitionBy("conv_id", "_block")
    rows = rows.withColumn(
        "_base", F.col("_size_before") + F.coalesce(F.sum("_size").over(here), F.lit(0))
    )
    speakers = (
        rows.where(~narrated).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective"))
        .distinct()
    )
    views = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    # The assistant's mark has another length than the name it stands for.
    own = F.col("role") == F.col("perspective")
    gain = (F.lit(len(OWN)) - F.length("_header")).cast("long")
    views = views.withColumn("_gain", F.when(own, gain).otherwise(F.lit(0).cast("long")))
    views = carried(views, ["conv_id", "perspective"], F.col("_gain"), "_gain_before")
    here = before.partitionBy("conv_id", "perspective", "_block")
    offset = (
        F.col("_base")
        + F.col("_gain_before")
        + F.coalesce(F.sum("_gain").over(here), F.lit(0))
    )
    mark = F.when(own, F.lit(OWN)).otherwise(F.col("_header"))
    pieces = views.select(
        "conv_id",
        "perspective",
        "_at",
        offset.alias("at"),
        F.concat(mark, "text", F.lit(STOP)).alias("piece"),
        F.when(
            own,
            F.struct(
                (offset + len(OWN)).alias("start"),
                (offset + len(OWN) + F.length("text") + len(STOP)).alias("end"),
            ),
        ).alias("mask"),
    ).withColumn("chunk", F.floor(F.col("at") / chunk).cast("long"))
    grouped = pieces.groupBy("conv_id", "perspective", "chunk").agg(
        F.min("at").alias("start"),
        F.sort_array(F.collect_list(F.struct("_at", "piece", "mask"))).alias("_p"),
    )
    return grouped.select(
        "conv_id",
        "perspective",
        "chunk",
        "start",
        F.size("_p").cast("long").alias("n_turns"),
        F.array_join(F.col("_p.piece"), "").alias("text"),
        F.filter(F.col("_p.mask"), lambda m: m.isNotNull()).alias("masks"),
    )
