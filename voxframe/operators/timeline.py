"""The time line: slices, splits, words, and the alignment of words to speaker turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.ordered import CHUNK, CHUNK_MS, chunked, filled, previous, row_numbers, running_sum
from voxframe.session import cut

#: Apostrophes and hyphens that tie a token to its neighbour (fixed values).
MARKS = "'’\\-‐‑"
#: Width of the buckets of the interval join.
BUCKET_MS = 15_000


def time_slices(turns: DataFrame, minutes: float = 15.0) -> DataFrame:
    """Set ``time_slice_id``, the tumbling slice of the start."""
    return turns.withColumn("time_slice_id", F.floor(F.col("start_ms") / (minutes * 60_000)).cast("int"))


def split_cluster(turns: DataFrame, cluster_id: str, at_ms: int, new_cluster_id: str) -> DataFrame:
    """Rename a cluster from a time on (inclusive)."""
    late = (F.col("cluster_id") == cluster_id) & (F.col("start_ms") >= at_ms)
    return turns.withColumn("cluster_id", F.when(late, F.lit(new_cluster_id)).otherwise(F.col("cluster_id")))


def apply_splits(turns: DataFrame, splits: DataFrame) -> DataFrame:
    """All splits of a session in their order; a later split sees the names that earlier ones gave.

    ``splits`` has ``session_id, seq, cluster_id, at_ms, new_cluster_id``, a few rows a session.
    """
    lists = splits.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "cluster_id", "at_ms", "new_cluster_id"))).alias("__splits"))
    step = lambda name, s: F.when((name == s["cluster_id"]) & (F.col("start_ms") >= s["at_ms"]), s["new_cluster_id"]).otherwise(name)
    renamed = F.aggregate(F.coalesce("__splits", F.array().cast("array<struct<seq:int,cluster_id:string,at_ms:bigint,new_cluster_id:string>>")), F.col("cluster_id"), step)
    return turns.join(lists, "session_id", "left").withColumn("cluster_id", renamed).drop("__splits")


def long_clips(turns: DataFrame, rate: int = 16_000, least: int = 2400) -> DataFrame:
    """Turns of at least ``least`` samples."""
    samples = F.floor(F.col("end_ms") * rate / 1000) - F.greatest(F.lit(0), F.floor(F.col("start_ms") * rate / 1000))
    return turns.withColumn("n_samples", samples).filter(F.col("n_samples") >= least)


def segment_words(segments: DataFrame) -> DataFrame:
    """``session_id, seq, pos, word, start_ms, end_ms`` of all words; a segment without words is one word.

    Words without times are left out. Needs segments with ``start_ms, end_ms, text, words``.
    """
    ms = lambda c: F.round(c * 1000).cast("long")
    own = F.transform("words", lambda w: F.struct(w["word"].alias("word"), ms(w["start"]).alias("start_ms"), ms(w["end"]).alias("end_ms")))
    whole = F.array(F.struct(F.col("text").alias("word"), "start_ms", "end_ms"))
    rows = segments.select("session_id", "seq", F.posexplode(F.when(F.size("words") > 0, own).otherwise(whole)).alias("pos", "w"))
    return rows.select("session_id", "seq", "pos", "w.word", "w.start_ms", "w.end_ms").filter("start_ms is not null and end_ms is not null")


def lexical_groups(words: DataFrame, gap_ms: int = 200) -> DataFrame:
    """Add ``group_no``: tokens in time order that belong together (elisions, hyphens, punctuation) share one.

    A token continues the group if it starts at most ``gap_ms`` after the end of the token before and it begins with a
    mark, holds no letter or digit, or the token before ends with a mark.
    """
    order = ["start_ms", "seq", "pos"]
    rows = cut(previous(chunked(words, "start_ms"), ["session_id"], order, ["word", "end_ms"]))
    trimmed = F.trim("word")
    tied = trimmed.rlike(f"^[{MARKS}]") | ((F.length(trimmed) > 0) & ~trimmed.rlike(r"[\p{L}\p{N}]")) | F.rtrim("prev_word").rlike(f"[{MARKS}]$")
    joins = F.coalesce((F.col("start_ms") - F.col("prev_end_ms") <= gap_ms) & tied, F.lit(False))
    return running_sum(rows.withColumn("__new", (~joins).cast("long")), ["session_id"], order, "__new", "group_no").drop("__new", "prev_word", "prev_end_ms", CHUNK)


def _buckets(start, end):
    return F.explode(F.sequence(F.floor(start / BUCKET_MS), F.floor(end / BUCKET_MS)))


def align_words(words: DataFrame, turns: DataFrame, gap_ms: int = 200) -> DataFrame:
    """``session_id, group_no, start_ms, end_ms, n_words, text, turn_id, cluster_id, uncertain`` of each lexical group.

    The turn with the greatest total overlap with the group's words; ties: the one whose centre is nearest the middle of
    the group, then the earlier start, the smaller id. A group without overlap whose first word has no length takes a turn
    that holds its middle (by the same order); any other takes the nearest turn (by distance of a turn's ends to the middle).
    ``uncertain`` tells whether turns of several clusters touch the group's words. ``turns`` has ``session_id, id,
    start_ms, end_ms, cluster_id``. Overlaps are found by an equi-join on buckets of time; only groups without overlap are
    compared with the turns before and after them.
    """
    grouped = cut(lexical_groups(words, gap_ms))
    first = F.min(F.struct("start_ms", "seq", "pos", "end_ms"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "seq", "pos", "word"))), lambda x: F.trim(x["word"])), "")
    groups = grouped.groupBy("session_id", "group_no").agg(first.alias("first"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"), joined.alias("text"))
    point = F.col("first.start_ms") == F.col("first.end_ms")
    groups = cut(groups.select("session_id", "group_no", "first.start_ms", "end_ms", "n_words", "text", point.alias("point")).withColumn("middle2", F.col("start_ms") + F.col("end_ms")))
    w = grouped.filter("end_ms >= start_ms").select("session_id", "group_no", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"), _buckets(F.col("start_ms"), F.col("end_ms")).alias("b"))
    t = turns.filter("end_ms > start_ms").select("session_id", F.col("id").alias("turn_id"), "cluster_id", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"))
    tb = t.withColumn("b", _buckets(F.col("ts"), F.col("te")))
    # a pair counts in the bucket where the later of the two begins
    pairs = w.join(tb, ["session_id", "b"]).filter("b = floor(greatest(ws, ts) / %d)" % BUCKET_MS)
    overlap = F.least("we", "te") - F.greatest("ws", "ts")
    on_point = (F.col("ws") == F.col("we")) & F.col("ws").between(F.col("ts"), F.col("te"))
    touching = pairs.withColumn("ov", F.greatest(F.lit(0), overlap)).filter((F.col("ov") > 0) | on_point)
    found = touching.groupBy("session_id", "group_no", "turn_id", "cluster_id", "ts", "te").agg(F.sum("ov").alias("ov"))
    ranked = found.join(groups.select("session_id", "group_no", "middle2"), ["session_id", "group_no"])
    key = F.struct((-F.col("ov")).alias("o"), F.abs(F.col("ts") + F.col("te") - F.col("middle2")).alias("d"), "ts", "turn_id", "cluster_id")
    best = cut(ranked.groupBy("session_id", "group_no").agg(F.min(F.when(F.col("ov") > 0, key)).alias("k"), (F.count_distinct("cluster_id") > 1).alias("uncertain")))
    matched = groups.join(best, ["session_id", "group_no"], "left")
    points = matched.filter("k is null and point").select("session_id", "group_no", "middle2", F.floor(F.col("middle2") / (2 * BUCKET_MS)).alias("b"))
    holding = points.join(tb, ["session_id", "b"]).filter((F.col("ts") * 2 <= F.col("middle2")) & (F.col("middle2") <= F.col("te") * 2)).withColumn("ov", F.lit(0).cast("long"))
    held = cut(holding.groupBy("session_id", "group_no").agg(F.min(key).alias("h")))
    lost = matched.filter("k is null").join(held.select("session_id", "group_no"), ["session_id", "group_no"], "left_anti").select("session_id", "group_no", "middle2")
    near = _nearest_turn(lost, t)
    result = matched.join(held, ["session_id", "group_no"], "left").join(near, ["session_id", "group_no"], "left")
    chosen = lambda c, n: F.coalesce(f"k.{c}", f"h.{c}", n).alias(c)
    return result.select("session_id", "group_no", "start_ms", "end_ms", "n_words", "text", chosen("turn_id", "near_id"), chosen("cluster_id", "near_cluster"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"))


def _nearest_turn(groups: DataFrame, turns: DataFrame) -> DataFrame:
    """The turn that ends last before, or starts first after, the middle of each group, whichever is nearer (ties: the earlier start, the smaller id)."""
    ends = turns.select("session_id", (F.col("te") * 2).alias("at"), F.struct("ts", "turn_id", "cluster_id").alias("t"), F.lit(None).cast("long").alias("group_no"))
    starts = turns.select("session_id", (F.col("ts") * 2).alias("at"), F.struct("ts", "turn_id", "cluster_id").alias("t"), F.lit(None).cast("long").alias("group_no"))
    asked = groups.select("session_id", F.col("middle2").alias("at"), F.lit(None).cast("struct<ts:bigint,turn_id:int,cluster_id:string>").alias("t"), "group_no")
    order = ["__at", "__asked", "__ts", "__id"]

    def side(rows: DataFrame, at: Column, out: str) -> DataFrame:
        every = rows.unionByName(asked).select("*", at.alias("__at"), F.col("t").isNull().alias("__asked"), (-F.col("t.ts")).alias("__ts"), (-F.col("t.turn_id")).alias("__id"), F.when(F.col("t").isNotNull(), F.struct("at", "t")).alias("v"))
        return filled(chunked(every, "__at", 2 * CHUNK_MS), ["session_id"], order, "v", out).filter("group_no is not null")

    # a group without a turn on its side is filled from the other one
    left = side(ends, F.col("at"), "l").select("session_id", "group_no", F.col("at").alias("m"), F.when(F.col("l.at") <= F.col("at"), F.col("l")).alias("l"))
    right = side(starts, F.coalesce(-F.col("at"), F.lit(2**61)), "r").select("session_id", "group_no", F.when(F.coalesce(F.col("r.at") >= F.col("at"), F.lit(True)), F.col("r")).alias("r"))
    both = left.join(right, ["session_id", "group_no"])
    far = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.abs(F.col(f"{v}.at") - F.col("m")).alias("d"), F.col(f"{v}.t.ts").alias("ts"), F.col(f"{v}.t.turn_id").alias("id"), F.col(f"{v}.t.cluster_id").alias("c")))
    nearest = F.least(far("l"), far("r"))
    return both.withColumn("x", nearest).select("session_id", "group_no", F.col("x.id").alias("near_id"), F.col("x.c").alias("near_cluster"))


def aligned_runs(aligned: DataFrame) -> DataFrame:
    """Contiguous groups of one turn: ``session_id, run_no, run_id, source_turn_id, start_ms, end_ms, cluster_id, text, uncertain``.

    The first run of a turn keeps its id; later ones get the greatest id of the session + 1, + 2 ... in order. Texts of
    the groups are joined by spaces.
    """
    order = ["start_ms", "group_no"]
    aligned = cut(aligned)
    rows = cut(previous(chunked(aligned.withColumn("__row", F.lit(1)), "start_ms"), ["session_id"], order, ["turn_id", "__row"]))
    new = (F.col("prev___row").isNull() | ~F.col("prev_turn_id").eqNullSafe(F.col("turn_id"))).cast("long")
    runs = running_sum(rows.withColumn("__new", new), ["session_id"], order, "__new", "run_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), " ")
    found = cut(runs.groupBy("session_id", "run_no").agg(F.first("turn_id").alias("source_turn_id"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("cluster_id").alias("cluster_id"), text.alias("text"), F.bool_or("uncertain").alias("uncertain")))
    again = (F.row_number().over(Window.partitionBy("session_id", "source_turn_id").orderBy("run_no")) > 1).cast("long")
    counted = running_sum(chunked(found.withColumn("__again", again), "start_ms"), ["session_id"], ["start_ms", "run_no"], "__again", "__n").drop(CHUNK)
    most = aligned.groupBy("session_id").agg(F.max("turn_id").alias("__max"))
    run_id = F.when(F.col("__again") == 0, F.col("source_turn_id")).otherwise(F.col("__max") + F.col("__n"))
    return counted.join(most, "session_id").withColumn("run_id", run_id.cast("long")).drop("__again", "__n", "__max")


def untimed_turns(segments: DataFrame) -> DataFrame:
    """One ``SPEAKER_00`` turn per segment where there is no diarization, numbered from 0 by position."""
    numbered = row_numbers(chunked(segments, "start_ms"), ["session_id"], ["start_ms", "seq"], "turn_id")
    return numbered.select("session_id", (F.col("turn_id") - 1).alias("turn_id"), "start_ms", "end_ms", F.lit("SPEAKER_00").alias("cluster_id"), "text")
