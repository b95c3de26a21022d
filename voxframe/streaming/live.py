"""Streaming forms of debouncing and enrolment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxframe.operators.vectors import enrol
from voxframe.session import table

TURN = "session_id string, turn_id long, start_ms long, end_ms long, speaker string, text string"


def debounce_stream(turns: DataFrame, threshold_ms: int = 2000, idle: str = "10 minutes") -> DataFrame:
    """Merged turns of a stream of turns that arrive in the order of their start in each session.

    ``turns`` has the columns of ``TURN`` and ``ingested_at``. A merged turn is emitted when a later turn can't continue
    it, or when its session was idle for ``idle`` by the watermark. State is one open turn a session.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            open_turn = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *open_turn)], columns=["session_id", "turn_id", "start_ms", "end_ms", "speaker", "text"])
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["start_ms", "turn_id"])
        now, done = list(state.get) if state.exists else None, []
        for r in rows.itertuples():
            if now and now[3] == (r.speaker or "") and r.start_ms - now[2] <= threshold_ms:
                now[2], now[4] = max(now[2], r.end_ms), f"{now[4]} {r.text or ''}".strip()
            else:
                if now:
                    done.append((key[0], *now))
                now = [int(r.turn_id), int(r.start_ms), int(r.end_ms), r.speaker or "", r.text or ""]
        state.update(tuple(now))
        state.setTimeoutTimestamp(int(max(state.getCurrentWatermarkMs(), 0) + pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(done, columns=["session_id", "turn_id", "start_ms", "end_ms", "speaker", "text"])

    marked = turns.withWatermark("ingested_at", idle)
    state = "turn_id long, start_ms long, end_ms long, speaker string, text string"
    return marked.groupBy("session_id").applyInPandasWithState(step, TURN, state, "append", GroupStateTimeout.EventTimeTimeout)


def profile_version(batches: int) -> str:
    """Name of the profiles after so many batches."""
    return f"v{(batches + 1) % 2 + 1}"


def enrol_stream(samples: DataFrame, path: str, checkpoint: str):
    """Enrols each micro-batch of ``speaker, sample_id, vector`` into the profiles stored under ``path``.

    Two versions take turns: batch n reads one and writes the other, so a repeated batch writes the same again, and no
    older ones are kept. The present profiles are those of ``profile_version``.
    """
    spark = samples.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        old = table(spark, path, profile_version(n)) if n else spark.createDataFrame([], "speaker string, centroid array<double>, sample_count long, sample_ids array<string>")
        enrol(batch, old).write.mode("overwrite").parquet(f"{path}/{profile_version(n + 1)}.parquet")

    return samples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)


def live_slices(turns: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """``session_id, slice, n_turns, speech_ms`` of turns by time of arrival, with a watermark for late rows."""
    window = F.window("ingested_at", f"{minutes} minutes")
    rows = turns.withWatermark("ingested_at", late).groupBy("session_id", window.alias("slice"))
    return rows.agg(F.count("*").alias("n_turns"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("speech_ms"))
