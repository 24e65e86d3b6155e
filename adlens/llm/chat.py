"""Chat formatting by multi-party perspective rotation (operator 9, native).

For every participant of a conversation the whole dialogue is rendered with that
speaker as ``assistant``, the other speakers as named users, and ``system``
turns as the system. The mask lists the character ranges (start, end
exclusive) of what the assistant says, end marker included.

A dialogue is returned in pieces of ``turns_per_part`` turns (``part`` 0, 1, ...), so that a
conversation with a third of all turns is many rows in many tasks. The pieces are
one dialogue: joined in order they are the whole chat, turns are numbered through, and
``start`` and the mask count characters from the beginning of the dialogue.

No step holds a conversation together. Turns are sorted by range partitioning (equal
turns are numbered, so they are dealt out too), counted per conversation and range, and numbered
by the running sum of these counts; a piece gathers ``turns_per_part`` turns;
the lengths of pieces are added up in blocks of 1,024 pieces, then over blocks.

Defined results: turns sort by turn number (null last), speaker and text; a null text is
empty; a null or empty speaker is called ``unknown``; a null conversation id is a
conversation of its own; repeated rows are rendered repeatedly; a
conversation of system turns alone has no participant and no row; markers
inside texts are defused; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlens.llm.common import keep_table

SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"
_BLOCK = 1024  # pieces whose lengths are added up together


def _defused(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, speaker, text) with ``number``: the place in the conversation, from 0."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("turn"), F.asc("speaker"), F.asc("text"), F.asc("tie")]
    # equal turns are counted, then told apart by their number, which a lost task would find again
    same = turns.groupBy(*turns.columns).agg(F.count(F.lit(1)).alias("n"))
    dealt = same.select(*turns.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("tie"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep_table(dealt.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "chat-turns")
    key = ["conv_id", "range"]
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(  # a row per range that the conversation is in
        F.col("conv_id").alias("of"), F.col("range").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy(*order[1:]))
    placed = ranged.withColumn("within", within).drop("tie")
    return (placed.join(offsets, placed["conv_id"].eqNullSafe(offsets["of"]) & (placed["range"] == offsets["in"]))
            .select("conv_id", "turn", "speaker", "text", (F.col("offset") + F.col("within") - 1).alias("number")))


def rotate_perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                        speaker_col: str = "role", text_col: str = "text", turns_per_part: int = 64) -> DataFrame:
    """``conv_id, perspective, part, n_turns, start, chat, mask`` (mask: array of start/end structs)."""
    speaker = F.col(speaker_col).cast("string")
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(F.coalesce(speaker, F.lit("")) == "", "unknown").otherwise(_defused(speaker)).alias("speaker"),
        _defused(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    people = (t.where(F.col("speaker") != SYSTEM)
              .select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct())

    def header(s: Column, mine: Column) -> Column:
        who = (F.when(s["speaker"] == SYSTEM, F.lit("system")).when(s["speaker"] == mine, F.lit("assistant"))
               .otherwise(F.concat(F.lit("user name="), s["speaker"])))
        return F.concat(F.lit(START), who, F.lit("\n"))

    said = F.array_sort(F.collect_list(F.struct("number", "speaker", "text")))
    parts = (_numbered(t).groupBy("conv_id", F.floor(F.col("number") / turns_per_part).cast("long").alias("part"))
             .agg(said.alias("said")))
    sizes = F.transform("said", lambda s: F.struct(s["speaker"].alias("speaker"), F.char_length(s["text"]).alias("n")))
    parts = keep_table(parts.withColumn("sizes", sizes), "chat-parts")

    # where every piece of every perspective starts, from the sizes alone
    thin = parts.select("conv_id", "part", "sizes").join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    per_turn = len(END) + 1
    length = F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, s: acc + s["n"] + per_turn + F.char_length(header(s, F.col("perspective"))))
    lengths = keep_table(thin.select("conv_id", "perspective", "part", F.floor(F.col("part") / _BLOCK).alias("block"), length.alias("length")),
                         "chat-lengths")
    dialogue = ["conv_id", "perspective"]
    ahead = Window.unboundedPreceding, -1
    blocks = lengths.groupBy(*dialogue, "block").agg(F.sum("length").alias("n")).select(
        F.col("conv_id").alias("b_conv"), F.col("perspective").alias("b_who"), F.col("block").alias("b"),
        F.sum("n").over(Window.partitionBy(*dialogue).orderBy("block").rowsBetween(*ahead)).alias("before"))
    inside = F.sum("length").over(Window.partitionBy(*dialogue, "block").orderBy("part").rowsBetween(*ahead))
    starts = lengths.withColumn("inside", inside).join(
        blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_who")) & (F.col("block") == F.col("b")))
    zero = F.lit(0).cast("long")
    starts = starts.select(F.col("conv_id").alias("s_conv"), "perspective", F.col("part").alias("s_part"),
                           (F.coalesce("inside", zero) + F.coalesce("before", zero)).alias("start"))

    rows = parts.select("conv_id", "part", "said").join(
        starts, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("part") == F.col("s_part")))
    mine = F.col("perspective")
    pieces = F.transform("said", lambda s: F.struct(
        header(s, mine).alias("head"), F.concat(s["text"], F.lit(END)).alias("body"), (s["speaker"] == mine).alias("own")))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (rows.withColumn("pieces", pieces)
            .select("conv_id", "perspective", "part", F.size("pieces").alias("n_turns"), "start",
                    F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
                    .alias("chat"),
                    F.aggregate("pieces", F.struct(F.col("start").alias("at"), none.alias("mask")), add,
                                lambda acc: acc["mask"]).alias("mask")))


def mask_text(mask: Column) -> Column:
    """``start:end`` of every masked range, joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
