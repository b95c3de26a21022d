"""Merging of overlapping intervals into periods, and the gaps between the periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time chunks that split one entity over several tasks.
CHUNK_MS = 1_800_000


def _carried(summary: DataFrame, keys: Sequence[str], chunk: str, value: str, out: str) -> DataFrame:
    """The greatest ``value`` of all earlier chunks of an entity; ``summary`` has one row per chunk."""
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, chunk, F.max(value).over(before).alias(out))


def with_latest_end(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], start: str, end: str, out: str, chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Add ``out``: the latest ``end`` of all rows before this one in the order of its entity.

    ``order`` must begin with ``start``. An entity is cut into chunks of ``chunk_ms`` of start time; each chunk is one
    window group and gets the latest end of the earlier chunks from a summary of one row per chunk, so a hot entity
    spreads over many tasks. Rows with a null start form a chunk of their own before all others. The chunk number stays
    in the column ``__chunk``.
    """
    rows = df.withColumn("__chunk", F.coalesce(F.floor(F.col(start) / chunk_ms), F.lit(-(2**62))))
    summary = rows.groupBy(*keys, "__chunk").agg(F.max(end).alias("__chunk_end"))
    carry = _carried(summary, keys, "__chunk", "__chunk_end", "__carried_end")
    before = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carry, [*keys, "__chunk"], "left")
    return joined.withColumn(out, F.greatest(F.max(end).over(before), F.col("__carried_end"))).drop("__carried_end")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, row_key: str, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Continuous periods of each entity: ``keys, start_ms, end_ms, n_rows, prev_end_ms``.

    ``start`` and ``end`` are whole numbers. Rows with a null key, start or end and rows with ``end <= start`` are left
    out. Rows that overlap, nest or touch form one period; ``prev_end_ms`` is the end of the period before (null for the
    first), so the gap before a period needs no second pass. A repeated row (same ``row_key``, start and end in an
    entity) counts once; ties of start and end are different rows if their ``row_key`` differs. An empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    wanted = F.lit(True)
    for k in keys:
        wanted = wanted & F.col(k).isNotNull()
    rows = df.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(row_key).alias("__id"))
    rows = rows.filter(wanted & (F.col("__e") > F.col("__s")))
    ordered = with_latest_end(rows, keys, ["__s", "__e", "__id"], "__s", "__e", "__latest", chunk_ms)
    by_chunk = Window.partitionBy(*keys, "__chunk").orderBy("__s", "__e", "__id")
    same = F.lag(F.struct("__s", "__e", "__id")).over(by_chunk).eqNullSafe(F.struct("__s", "__e", "__id"))
    opens = F.col("__latest").isNull() | (F.col("__s") > F.col("__latest"))
    flagged = ordered.withColumns({"__again": same, "__open": F.when(opens, F.col("__s")), "__before": F.when(opens, F.col("__latest"))})
    local = flagged.withColumn("__period", F.max("__open").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = local.groupBy(*keys, "__chunk", "__period").agg(
        F.max("__e").alias("__e"), F.sum((~F.col("__again")).cast("long")).alias("__n"), F.max("__before").alias("__before")
    )
    carry = _carried(pieces.groupBy(*keys, "__chunk").agg(F.max("__period").alias("__last")), keys, "__chunk", "__last", "__carried")
    whole = pieces.join(carry, [*keys, "__chunk"], "left").withColumn("start_ms", F.coalesce("__period", "__carried"))
    return whole.groupBy(*keys, "start_ms").agg(
        F.max("__e").alias("end_ms"), F.sum("__n").alias("n_rows"), F.max("__before").alias("prev_end_ms")
    )


def periods_and_gaps(periods: DataFrame, keys: Sequence[str], min_rows: int = 2, max_gap: int = 10_000) -> DataFrame:
    """``keys, kind, start_ms, end_ms``: periods of at least ``min_rows`` rows and gaps of at most ``max_gap``."""
    merged = F.struct(F.lit("period").alias("kind"), F.col("start_ms"), F.col("end_ms"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("prev_end_ms").alias("start_ms"), F.col("start_ms").alias("end_ms"))
    short = F.col("prev_end_ms").isNotNull() & (F.col("start_ms") - F.col("prev_end_ms") <= max_gap)
    both = F.array_compact(F.array(F.when(F.col("n_rows") >= min_rows, merged), F.when(short, gap)))
    return periods.select(*keys, F.inline(both))
