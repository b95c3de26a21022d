"""Names of speakers: precedence of manual choices, propagation, and additions to a mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.operators.ordered import CHUNK, chunked, filled

PLACEHOLDER = "SPEAKER_"


def apply_mapping(turns: DataFrame, turn_names: DataFrame, slice_names: DataFrame, cluster_names: DataFrame) -> DataFrame:
    """Set ``speaker``: the name of the turn, else of the cluster in the time slice, else of the cluster, else the present speaker, else the cluster.

    A turn's own id is looked up first, then its source turn's. Tables: ``turn_names(session_id, turn_id, name)``,
    ``slice_names(session_id, time_slice_id, cluster_id, name)``, ``cluster_names(session_id, cluster_id, name)``, each
    unique by its key. A blank present speaker, or one that equals the cluster, doesn't count.
    """
    own = turn_names.select("session_id", "turn_id", F.col("name").alias("__own"))
    source = turn_names.select("session_id", F.col("turn_id").alias("source_turn_id"), F.col("name").alias("__source"))
    in_slice = slice_names.select("session_id", "time_slice_id", "cluster_id", F.col("name").alias("__slice"))
    default = cluster_names.select("session_id", "cluster_id", F.col("name").alias("__default"))
    joined = turns.join(own, ["session_id", "turn_id"], "left").join(source, ["session_id", "source_turn_id"], "left")
    joined = joined.join(in_slice, ["session_id", "time_slice_id", "cluster_id"], "left").join(default, ["session_id", "cluster_id"], "left")
    present = F.when((F.col("speaker") != "") & (F.col("speaker") != F.col("cluster_id")), F.col("speaker"))
    return joined.withColumn("speaker", F.coalesce("__own", "__source", "__slice", "__default", present, "cluster_id")).drop("__own", "__source", "__slice", "__default")


def propagate_labels(turns: DataFrame, turn_names: DataFrame, cluster_names: DataFrame, prefix: str = PLACEHOLDER) -> DataFrame:
    """``session_id, turn_id, name`` of turns whose placeholder name is replaced by the last real name before it, else the first after it.

    A turn's name is its own, else its cluster's, else the cluster; blank names don't count.
    """
    own = turn_names.select("session_id", "turn_id", F.nullif("name", F.lit("")).alias("__own"))
    default = cluster_names.select("session_id", "cluster_id", F.nullif("name", F.lit("")).alias("__default"))
    named = turns.join(own, ["session_id", "turn_id"], "left").join(default, ["session_id", "cluster_id"], "left").withColumn("__name", F.coalesce("__own", "__default", "cluster_id"))
    real = named.withColumn("__real", F.when(~F.col("__name").startswith(prefix), F.col("__name")))
    done = filled(chunked(real, "start_ms"), ["session_id"], ["start_ms", "turn_id"], "__real", "name").drop(CHUNK)
    return done.filter(F.col("__real").isNull() & F.col("name").isNotNull()).select("session_id", "turn_id", "name")


def insert_absent(names: DataFrame, matches: DataFrame, source: str = "profile_match") -> DataFrame:
    """Cluster names with the matches of clusters that had none, labelled with their source."""
    new = matches.join(names, ["session_id", "cluster_id"], "left_anti").select("session_id", "cluster_id", "name", F.lit(source).alias("source"))
    return names.select("session_id", "cluster_id", "name", "source").unionByName(new)


def manual_sources(names: DataFrame, prefix: str = PLACEHOLDER) -> DataFrame:
    """A real name without a source was given by hand."""
    bare = F.col("source").isNull() & ~F.col("name").startswith(prefix)
    return names.withColumn("source", F.when(bare, F.lit("manual")).otherwise(F.col("source")))


def may_enrol(names: DataFrame, prefix: str = PLACEHOLDER) -> DataFrame:
    """``session_id, may_enrol``: whether a session has a real name given by hand."""
    return names.groupBy("session_id").agg(F.coalesce(F.bool_or((F.col("source") == "manual") & ~F.col("name").startswith(prefix)), F.lit(False)).alias("may_enrol"))


def is_unassigned(name: Column, prefix: str = PLACEHOLDER) -> Column:
    return F.coalesce(name.startswith(prefix), F.lit(True))


def review_clusters(stats: DataFrame, names: DataFrame, min_turns: int = 0, min_ms: int = 0, only_unassigned: bool = False) -> DataFrame:
    """Cluster figures worth a review, after the figures are aggregated."""
    joined = stats.join(names.select("session_id", "cluster_id", "name"), ["session_id", "cluster_id"], "left")
    kept = joined.filter((F.col("n_turns") >= min_turns) & (F.col("total_ms") >= min_ms))
    return kept.filter(is_unassigned(F.col("name"))) if only_unassigned else kept


def auto_assign(names: DataFrame, matches: DataFrame, prefix: str = PLACEHOLDER) -> DataFrame:
    """Names of clusters with the matches of those that have none or a placeholder; real names stay.

    ``matches`` has ``session_id, cluster_id, name``.
    """
    found = matches.select("session_id", "cluster_id", F.col("name").alias("__match"))
    joined = names.join(found, ["session_id", "cluster_id"], "full")
    taken = is_unassigned(F.col("name"), prefix) & F.col("__match").isNotNull()
    source = F.when(taken, F.lit("profile_match")).otherwise(F.col("source"))
    return joined.select("session_id", "cluster_id", F.when(taken, F.col("__match")).otherwise(F.col("name")).alias("name"), source.alias("source"))
