"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.joins import joined_spread
from voxframe.session import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step that links the neighbours of each node to the least of them: the larger neighbours, or the smaller ones."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    joined = joined_spread(around, least, ["a"], "b")
    if large:
        linked = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: every node of ``edges`` (long ``a``, ``b``) but the roots, with the smallest node of its component.

    Alternating large and small stars, each written to the shared folder, until nothing changes; the rounds grow as the
    logarithm of the longest chain. Self-links and repeated links change nothing; links with a null end are left out.
    """
    now = cut(edges.filter("a <> b").select("a", "b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = state
        now = cut(_stars(_stars(now, True), False))
