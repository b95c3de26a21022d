"""Window-like operators over long ordered entities, split into chunks so that one entity spreads over many tasks.

Every function works on rows that have a chunk column from ``chunked``: rows are windowed within (keys, chunk) and get what
they need of earlier chunks from a summary of one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
CHUNK_MS = 1_800_000


def chunked(df: DataFrame, time: str, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Add the chunk number; rows with a null time come before all others."""
    return df.withColumn(CHUNK, F.coalesce(F.floor(F.col(time) / chunk_ms), F.lit(-(2**62))))


def _local(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _earlier(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``, 1, 2, ... in the order of each entity."""
    counts = df.groupBy(*keys, CHUNK).agg(F.count("*").alias("__n"))
    before = counts.select(*keys, CHUNK, F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias("__before"))
    return df.join(before, [*keys, CHUNK]).withColumn(out, F.row_number().over(_local(keys, order)) + F.col("__before")).drop("__before")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``, the sum of ``value`` up to and with each row."""
    sums = df.groupBy(*keys, CHUNK).agg(F.sum(value).alias("__n"))
    before = sums.select(*keys, CHUNK, F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias("__before"))
    own = F.sum(value).over(_local(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(before, [*keys, CHUNK]).withColumn(out, F.coalesce(own, F.lit(0)) + F.col("__before")).drop("__before")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add the values of the row before as ``prefix + name``, null in the first row."""
    both = F.struct(*columns)
    last = df.groupBy(*keys, CHUNK).agg(F.max_by(both, F.struct(*order)).alias("__last"))
    earlier = last.select(*keys, CHUNK, F.lag("__last").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("__earlier"))
    local = _local(keys, order)
    joined = df.join(earlier, [*keys, CHUNK]).withColumn("__first", F.row_number().over(local) == 1).withColumn("__lag", F.lag(both).over(local))
    chosen = F.when(F.col("__first"), F.col("__earlier")).otherwise(F.col("__lag"))
    return joined.withColumns({prefix + c: chosen[c] for c in columns}).drop("__earlier", "__first", "__lag")


def filled(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: ``value``, else the last one before it that isn't null, else the first one after it."""
    local = _local(keys, order)
    ends = df.groupBy(*keys, CHUNK).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last"), F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__first")
    )
    later = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
    sides = ends.select(*keys, CHUNK, F.last("__last", True).over(_earlier(keys)).alias("__before"), F.first("__first", True).over(later).alias("__after"))
    back = F.last(value, True).over(local.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, True).over(local.rowsBetween(0, Window.unboundedFollowing))
    return df.join(sides, [*keys, CHUNK]).withColumn(out, F.coalesce(back, "__before", ahead, "__after")).drop("__before", "__after")
