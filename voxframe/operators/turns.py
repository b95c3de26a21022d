"""Speaker turns: interleaving of tracks, merging of close turns, numbering, labels and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.intervals import with_latest_end
from voxframe.operators.ordered import CHUNK, chunked, filled, previous, row_numbers, running_sum
from voxframe.session import cut


def interleave(segments: DataFrame) -> DataFrame:
    """One time line out of several tracks: ``turn_id`` from 0 by (start, track as text, seq) in each session.

    Needs ``session_id, track_id, seq, start_ms``. Null starts come first; ties of all three keep any order.
    """
    numbered = row_numbers(chunked(segments, "start_ms"), ["session_id"], ["start_ms", "track_id", "seq"], "turn_id")
    return numbered.withColumn("turn_id", F.col("turn_id") - 1).drop(CHUNK)


def debounce(turns: DataFrame, threshold_ms: int = 2000) -> DataFrame:
    """Merge a turn into the one before if the speaker is the same and it starts at most ``threshold_ms`` after the latest end.

    Needs ``session_id, turn_id, start_ms, end_ms, speaker, text, uncertain``. Order is (start, turn_id). A merged turn has
    the id, start and speaker of its first, the latest end, the joined texts and whether any was uncertain. A null speaker
    equals a null speaker; a null text adds nothing; an empty table gives no rows. Steps that are read twice are written to
    the shared folder.
    """
    order = ["start_ms", "turn_id"]
    rows = cut(previous(chunked(turns.withColumn("__row", F.lit(1)), "start_ms"), ["session_id"], order, ["speaker", "__row"]))
    change = (F.col("prev___row").isNull() | ~F.col("prev_speaker").eqNullSafe(F.col("speaker"))).cast("long")
    islands = running_sum(rows.withColumn("__change", change), ["session_id"], order, "__change", "__island").drop(CHUNK)
    ends = cut(with_latest_end(islands, ["session_id", "__island"], order, "start_ms", "end_ms", "__latest"))
    opens = (F.col("__latest").isNull() | (F.col("start_ms") - F.col("__latest") > threshold_ms)).cast("long")
    groups = running_sum(ends.withColumn("__open", opens), ["session_id", "__island"], order, "__open", "__group")
    first = lambda c: F.min_by(c, F.struct(*order))
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), lambda x: x.isNotNull())
    merged = groups.groupBy("session_id", "__island", "__group").agg(
        first("turn_id").alias("turn_id"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), first("speaker").alias("speaker"),
        F.trim(F.array_join(texts, " ")).alias("text"), F.bool_or("uncertain").alias("uncertain"), F.count("*").alias("n_turns"),
    )
    return merged.drop("__island", "__group")


#: Parts in which the first texts of a cluster are looked for.
PARTS = 32


def cluster_stats(turns: DataFrame, samples: int = 4) -> DataFrame:
    """``session_id, cluster_id, n_turns, total_ms, first_seq, samples``: figures of each cluster and its first texts.

    The first texts are those of ``PARTS`` parts of each cluster, taken together, so a hot cluster isn't sorted in one task.
    """
    key = ["session_id", "cluster_id"]
    stats = turns.groupBy(*key).agg(F.count("*").alias("n_turns"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.min("seq").alias("first_seq"))
    part = turns.select(*key, "seq", "turn_id", "text", F.pmod(F.xxhash64("turn_id"), F.lit(PARTS)).alias("__part"))
    ranked = part.withColumn("__n", F.row_number().over(Window.partitionBy(*key, "__part").orderBy("seq", "turn_id"))).filter(F.col("__n") <= samples)
    firsts = F.slice(F.array_sort(F.collect_list(F.struct("seq", "turn_id", "text"))), 1, samples)
    lists = ranked.groupBy(*key).agg(F.transform(firsts, lambda x: x["text"]).alias("samples"))
    # null clusters are a cluster of their own
    same = F.col("s.session_id").eqNullSafe(F.col("l.session_id")) & F.col("s.cluster_id").eqNullSafe(F.col("l.cluster_id"))
    return stats.alias("s").join(lists.alias("l"), same).select("s.*", "l.samples")


def first_appearance_labels(turns: DataFrame, out: str = "label") -> DataFrame:
    """Add ``SPEAKER_00``, ``SPEAKER_01`` ... to clusters in the order in which they appear in their session."""
    firsts = turns.filter(F.col("cluster_id").isNotNull()).groupBy("session_id", "cluster_id").agg(F.min(F.struct("seq", "turn_id")).alias("__at"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("__at")) - 1
    labels = firsts.select("session_id", "cluster_id", F.format_string("SPEAKER_%02d", number).alias(out))
    return turns.join(labels, ["session_id", "cluster_id"], "left")


def carry_labels(rows: DataFrame, label: str = "label", out: str = "carried") -> DataFrame:
    """Rows without a label take the label before them, leading ones the first label after them."""
    return filled(chunked(rows, "start_ms"), ["session_id"], ["start_ms", "turn_id"], label, out).drop(CHUNK)


def session_figures(turns: DataFrame) -> DataFrame:
    """``session_id, max_turn_ms, max_id, last_end_ms, n_speakers`` of each session."""
    return turns.groupBy("session_id").agg(
        F.max(F.col("end_ms") - F.col("start_ms")).alias("max_turn_ms"), F.max("turn_id").alias("max_id"), F.max("end_ms").alias("last_end_ms"), F.count_distinct("cluster_id").alias("n_speakers")
    )
