"""Reuse of stored results by where they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt_hash(prompt: Column) -> Column:
    """16 hex digits of the SHA-256, ``no_prompt`` for none."""
    return F.when(F.coalesce(prompt, F.lit("")) == "", F.lit("no_prompt")).otherwise(F.left(F.sha2(prompt, 256), F.lit(16)))


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def entity_fingerprint(rows: DataFrame) -> DataFrame:
    """``session_id, fingerprint``: SHA-256 over ``id:start_ms:end_ms:text`` of a session's rows in the order of their ids."""
    line = F.concat_ws(":", F.col("id").cast("string"), F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), F.coalesce("text", F.lit("")))
    lists = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("x"))
    return lists.select("session_id", F.sha2(F.array_join(F.transform("x", lambda r: r["line"]), ";"), 256).alias("fingerprint"))


def transcript_hits(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Stored transcripts that the expected provenance may use: media, engine, model, compute type, prompt and language are equal (null equals null)."""
    keys = ["media_hash", "engine", "model_name", "compute_type", "prompt_hash", "language"]
    s, e = stored.alias("s"), expected.alias("e")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return s.join(e, condition, "left_semi")


def diarization_usable(stored: str = "s", expected: str = "e") -> Column:
    """Whether a stored diarization fits an expected one: ``auto`` takes what it would resolve to, a device ``auto`` fits any, the transcript counts only if one is expected."""
    s, e = (lambda c: F.col(f"{stored}.{c}")), (lambda c: F.col(f"{expected}.{c}"))
    either = lambda name: (s("engine") == name) | s("resolved_engine").eqNullSafe(F.lit(name))
    automatic = F.when(e("resolved_engine").eqNullSafe(F.lit("ecapa")), either("ecapa")).otherwise((s("engine") == "auto") | either("nemotron") | either("ecapa"))
    explicit = ((s("engine") == e("engine")) | s("resolved_engine").eqNullSafe(e("engine"))) & (e("resolved_engine").isNull() | s("resolved_engine").eqNullSafe(e("resolved_engine")))
    engine = F.when(e("engine") == "auto", automatic).otherwise(explicit)
    device = (s("device") == e("device")) | (s("device") == "auto") | (e("device") == "auto")
    transcript = e("transcript_hash").isNull() | s("transcript_hash").eqNullSafe(e("transcript_hash"))
    return F.coalesce((s("media_hash") == e("media_hash")) & engine & device & transcript & (s("threshold") == e("threshold")) & s("num_speakers").eqNullSafe(e("num_speakers")), F.lit(False))


def track_usable(stored: str = "s", expected: str = "e", tolerance: float = 1e-4) -> Column:
    """Whether a stored track fits: name, model, size and language are equal, the file time within ``tolerance`` seconds."""
    s, e = (lambda c: F.col(f"{stored}.{c}")), (lambda c: F.col(f"{expected}.{c}"))
    return (s("track") == e("track")) & s("model_name").eqNullSafe(e("model_name")) & s("language").eqNullSafe(e("language")) & (s("size") == e("size")) & (F.abs(s("mtime") - e("mtime")) < tolerance)


def complete_embeddings(provenance: DataFrame, rows: DataFrame, key: str = "media_hash") -> DataFrame:
    """Provenance rows with a transcript hash whose number of stored embeddings is the recorded one."""
    counted = rows.groupBy(key).agg(F.count("*").alias("__n"))
    return provenance.filter(F.coalesce("transcript_hash", F.lit("")) != "").join(counted, key).filter("count = __n").drop("__n")


def usable_embeddings(stored: DataFrame, expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored embeddings of segments or turns that the expected provenance may use.

    ``stored`` and ``expected`` have ``media_hash, entity_kind, model, source_hash, fingerprint, count``, ``rows`` the stored
    vectors with ``media_hash, entity_kind``. All fields have to be equal, the hash of the source not blank, and as many
    vectors stored as recorded.
    """
    keys = ["media_hash", "entity_kind", "model", "source_hash", "fingerprint", "count"]
    counted = rows.groupBy("media_hash", "entity_kind").agg(F.count("*").alias("__n"))
    complete = stored.filter(F.coalesce("source_hash", F.lit("")) != "").join(counted, ["media_hash", "entity_kind"]).filter("count = __n").drop("__n")
    return complete.join(expected.select(*keys), keys, "left_semi")
