"""Queries of the general data-processing problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.functions.timeexpr import to_ms
from voxframe.operators.intervals import merge_intervals, periods_and_gaps
from voxframe.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "diar_turns").select("session_id", "cluster_id", "id", to_ms("start").alias("s"), to_ms("end").alias("e"))
    periods = merge_intervals(turns, ["session_id", "cluster_id"], "s", "e", "id")
    return periods_and_gaps(periods, ["session_id", "cluster_id"])


QUERIES = {"p1_found": p1_found}

P1_SQL = """
WITH t AS (
  SELECT DISTINCT session_id, cluster_id, id, CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e
  FROM diar_turns WHERE session_id IS NOT NULL AND cluster_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL
), u AS (SELECT * FROM t WHERE e > s), m AS (
  SELECT *, max(e) OVER (PARTITION BY session_id, cluster_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM u
), g AS (
  SELECT *, sum(CASE WHEN le IS NULL OR s > le THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, cluster_id ORDER BY s, e, id) AS isl FROM m
), p AS (SELECT session_id, cluster_id, isl, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY ALL), q AS (
  SELECT *, lead(s) OVER (PARTITION BY session_id, cluster_id ORDER BY s) AS nxt FROM p
)
SELECT session_id, cluster_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM q WHERE n >= 2
UNION ALL
SELECT session_id, cluster_id, 'gap' AS kind, e AS start_ms, nxt AS end_ms FROM q WHERE nxt - e <= 10000
"""

ORACLES = {"p1_found": P1_SQL}
