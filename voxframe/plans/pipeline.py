"""The stages of a transcript, composed of operators: single recording, several tracks, review, re-clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators import attribution, timeline, turns, vectors
from voxframe.session import cut
from voxframe.sources.render import render_markdown
from voxframe.sources.tables import track_username

_NO_TURN_NAMES = "session_id string, turn_id int, name string"
_NO_SLICE_NAMES = "session_id string, time_slice_id int, cluster_id string, name string"


def _none(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def run(segments: DataFrame, diarization: DataFrame, cluster_names: DataFrame, turn_names: DataFrame | None = None, slice_names: DataFrame | None = None, minutes: float = 15.0) -> DataFrame:
    """Named, debounced turns of recordings: words are aligned to turns, runs sliced, named and merged.

    ``segments`` and ``diarization`` as in ``timeline.align_words``; the result is that of ``turns.debounce``. Words of
    sessions without turns are left to ``timeline.untimed_turns``.
    """
    aligned = timeline.align_words(timeline.segment_words(segments), diarization).filter("turn_id is not null")
    runs = timeline.time_slices(timeline.aligned_runs(aligned), minutes)
    shaped = runs.select("session_id", F.col("run_id").cast("int").alias("turn_id"), F.col("source_turn_id").cast("int").alias("source_turn_id"), "start_ms", "end_ms", "cluster_id", F.col("cluster_id").alias("speaker"), "time_slice_id", "text", "uncertain")
    return review(shaped, cluster_names, turn_names, slice_names)


def review(aligned: DataFrame, cluster_names: DataFrame, turn_names: DataFrame | None = None, slice_names: DataFrame | None = None) -> DataFrame:
    """Stored turns under other names, merged again."""
    own = _none(aligned, _NO_TURN_NAMES) if turn_names is None else turn_names
    in_slice = _none(aligned, _NO_SLICE_NAMES) if slice_names is None else slice_names
    return turns.debounce(cut(attribution.apply_mapping(aligned, own, in_slice, cluster_names)))


def track_labels(tracks: DataFrame, roster: DataFrame) -> DataFrame:
    """Add ``speaker`` to rows with ``track_id``: ``Character (user)`` of the roster's user, whose name may be in another case; else the user of the track.

    ``roster`` has ``username, character_name``, and ``ord`` and ``is_dm`` if there are such; of users that differ in case
    only, the exact one is taken, else the first (by ``ord``, else by name). A game master without a name is ``MJ``, another person without one the user.
    """
    order, master = F.col("ord" if "ord" in roster.columns else "username"), F.coalesce("is_dm", F.lit(False)) if "is_dm" in roster.columns else F.lit(False)
    people = roster.filter("username is not null").select(order.alias("ord"), "username", F.nullif("character_name", F.lit("")).alias("character"), master.alias("is_dm"))
    label = F.concat(F.coalesce("character", F.when(F.col("is_dm"), F.lit("MJ")), "username"), F.lit(" ("), "username", F.lit(")"))
    exact = people.groupBy(F.col("username").alias("__user")).agg(F.min_by(label, "ord").alias("__exact"))
    folded = people.groupBy(F.lower("username").alias("__low")).agg(F.min_by(label, "ord").alias("__folded"))
    named = tracks.withColumn("__user", track_username(F.col("track_id"))).withColumn("__low", F.lower("__user"))
    joined = named.join(exact, "__user", "left").join(folded, "__low", "left")
    return joined.withColumn("speaker", F.coalesce("__exact", "__folded", "__user")).drop("__user", "__low", "__exact", "__folded")


def multitrack(tracks: DataFrame, roster: DataFrame) -> DataFrame:
    """Debounced turns of several tracks, interleaved and labelled by the roster (``track_labels``).

    ``tracks`` has ``session_id, track_id, seq, start_ms, end_ms, text``.
    """
    return turns.debounce(cut(track_labels(turns.interleave(tracks), roster).withColumn("uncertain", F.lit(False))))


def auto_assign(embeddings: DataFrame, names: DataFrame, profiles: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Names of clusters, those without one (or with a placeholder) filled with the most similar voice.

    Voices are the profiles and the clusters named by now (``vectors.profiles_of_named``). ``embeddings`` has
    ``session_id, cluster_id, vector``, ``names`` ``session_id, cluster_id, name, source``, ``profiles`` ``speaker, vector``.
    """
    voices = vectors.profiles_of_named(embeddings, names, profiles)
    # a number for each voice, for ties: by name
    voices = cut(voices.withColumn("ord", F.xxhash64("speaker")))
    means = vectors.mean_vectors(embeddings, ["session_id", "cluster_id"], "vector")
    asked = means.select(F.to_json(F.struct("session_id", "cluster_id")).alias("query"), F.col("mean").alias("vector"))
    found = vectors.best_profiles(asked, voices, None, allowed)
    key = F.from_json("query", "session_id string, cluster_id string")
    return attribution.auto_assign(names, found.select(key.alias("k"), F.col("speaker").alias("name")).select("k.session_id", "k.cluster_id", "name"))


def recluster(embeddings: DataFrame, profiles: DataFrame, threshold: float = 0.6, **clustering) -> DataFrame:
    """``session_id, label, name, cosine``: new clusters of stored vectors and the profiles that match their means."""
    labels = cut(vectors.recluster(embeddings, **clustering))
    rows = embeddings.select(F.col("session_id").cast("string").alias("session_id"), F.col("id").cast("long").alias("id"), "vector").join(labels, ["session_id", "id"])
    means = vectors.mean_vectors(rows, ["session_id", "label"], "vector")
    asked = means.select(F.concat_ws("\x01", "session_id", "label").alias("query"), F.col("mean").alias("vector"))
    found = vectors.best_profiles(asked, profiles, threshold)
    both = F.split("query", "\x01")
    return found.select(F.get(both, 0).alias("session_id"), F.get(both, 1).alias("label"), F.col("speaker").alias("name"), "cosine")


def transcripts(named: DataFrame) -> DataFrame:
    return render_markdown(named)
