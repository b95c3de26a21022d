"""Joins with small tables of which single keys may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows than this is broadcast and its rows are spread.
HOT_ROWS = 100_000
#: Parts over which the rows of hot keys are spread.
PARTS = 1 << 20


def joined_spread(rows: DataFrame, small: DataFrame, keys: Sequence[str], spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small``, which has one row per key and the key's number of rows in the column ``n``.

    Keys of more than ``HOT_ROWS`` rows, of which there are at most rows / ``HOT_ROWS``, are broadcast; their rows are spread
    over all tasks by the column ``spread``, so a key that is a third of all rows isn't one task. ``how`` is ``inner`` or
    ``left``. The columns of ``small`` but the keys are added; null keys find nothing.
    """
    added = [c for c in small.columns if c not in keys]
    hot = F.broadcast(small.filter(F.col("n") > HOT_ROWS).select(*keys, F.struct(*added).alias("__hot")))
    other = small.filter(F.col("n") <= HOT_ROWS).select(*keys, F.lit(0).alias("__salt"), F.struct(*added).alias("__other"))
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    # rows of hot keys, and those without a key, go to any task
    salt = F.when(F.col("__hot").isNotNull() | empty, F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int") + 1).otherwise(0)
    both = rows.join(hot, list(keys), "left").withColumn("__salt", salt).join(other, [*keys, "__salt"], "left")
    found = both.withColumn("__found", F.coalesce("__hot", "__other"))
    kept = found if how == "left" else found.filter("__found is not null")
    return kept.select(*rows.columns, *[F.col(f"__found.{c}").alias(c) for c in added])
