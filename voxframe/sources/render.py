"""Markdown transcripts and their pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.timeexpr import format_timestamp
from voxframe.operators.refine import ASIDE, NOTICE


def turn_blocks(turns: DataFrame) -> DataFrame:
    """Add ``block``: heading with times and speaker, empty line, text."""
    span = F.concat(F.lit("### ["), format_timestamp(F.col("start_ms") / 1000), F.lit(" - "), format_timestamp(F.col("end_ms") / 1000), F.lit("] "), F.coalesce("speaker", F.lit("")))
    return turns.withColumn("block", F.concat(span, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")))


def render_markdown(turns: DataFrame, notice: str = NOTICE) -> DataFrame:
    """``session_id, markdown``: one document a session, blocks in the order of (start, turn_id), one notice if any turn is uncertain.

    A transcript is one value and so as long as its session; use ``turn_blocks`` where rows are enough.
    """
    blocks = turn_blocks(turns).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "turn_id", "block"))).alias("b"), F.bool_or("uncertain").alias("u"))
    body = F.array_join(F.transform("b", lambda x: x["block"]), "\n")
    return blocks.select("session_id", F.concat(F.when(F.col("u"), F.lit(notice + "\n\n")).otherwise(F.lit("")), F.rtrim(F.regexp_replace(body, r"\n+$", "")), F.lit("\n")).alias("markdown"))


def piece_blocks(pieces: DataFrame, timestamps: bool = True) -> DataFrame:
    """Add ``block`` to repaired or source pieces with ``speaker, start, end, text, out_of_game``: heading with the times if both are known and wanted, empty line, text, quoted below a callout if it is no part of the game."""
    timed = F.col("start").isNotNull() & F.col("end").isNotNull() & F.lit(timestamps)
    heading = F.concat(F.lit("### "), F.when(timed, F.concat(F.lit("["), "start", F.lit(" - "), "end", F.lit("] "))).otherwise(F.lit("")), F.coalesce("speaker", F.lit("")))
    quoted = F.concat(F.lit(ASIDE + "\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    text = F.when(F.coalesce("out_of_game", F.lit(False)), quoted).otherwise(F.col("text"))
    return pieces.withColumn("block", F.concat(heading, F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit("\n\n")))
