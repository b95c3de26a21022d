"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.timeexpr import to_ms
from voxframe.llm.clusters import similarity_clusters
from voxframe.llm.langid import identify_languages
from voxframe.llm.names import link_names
from voxframe.llm.nearest_time import nearest_in_time
from voxframe.llm.neighbours import similar_vectors
from voxframe.llm.packing import pack
from voxframe.llm.runs import collapse_runs, folded_label
from voxframe.llm.tokens import encode_corpus, token_counts
from voxframe.llm.transcripts import clean_turns
from voxframe.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, typical = similarity_clusters(table(spark, sf_dir, "profiles"), "ord", "centroid")
    rows = members.filter("n >= 2").select("root", "id", F.lit("member").alias("role"))
    both = rows.unionByName(typical.select("root", "id", F.lit("typical").alias("role")))
    return both.select(F.col("root").cast("int").alias("cluster_ord"), F.col("id").cast("int").alias("ord"), "role")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "aligned").select("session_id", "turn_id", to_ms("start").alias("s"), to_ms("end").alias("e"), folded_label("speaker").alias("label"))
    runs = collapse_runs(turns, "session_id", "s", "e", "turn_id", "label").filter("n_rows >= 2")
    return runs.select("session_id", F.col("first_key").cast("int").alias("first_turn_id"), F.col("last_key").cast("int").alias("last_turn_id"), F.col("n_rows").alias("n_turns"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "profiles"), "ord", "centroid")
    return near.select(F.least("id", "other").cast("int").alias("ord_a"), F.greatest("id", "other").cast("int").alias("ord_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are half milliseconds: twice the start of a turn, start plus end of a word."""
    turns = table(spark, sf_dir, "diar_turns").select("session_id", "id", (to_ms("start") * 2).alias("tick"))
    segments = table(spark, sf_dir, "segments").select("session_id", "seq", F.posexplode("words").alias("pos", "w"))
    words = segments.select(F.col("session_id").alias("entity"), (to_ms("w.start") + to_ms("w.end")).alias("tick"), F.col("seq").alias("rank_a"), F.col("pos").alias("rank_b"))
    near = nearest_in_time(turns.withColumnRenamed("session_id", "entity"), words, 500)
    hit = near.select(F.col("entity").alias("session_id"), F.col("asked").alias("tick"), F.col("rank_a").cast("int").alias("seq"), F.col("rank_b").cast("int").alias("pos"))
    return turns.join(hit, ["session_id", "tick"]).select("session_id", "id", "seq", "pos").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "aligned").select(F.col("session_id").alias("session"), F.col("campaign_id").alias("campaign"), "turn_id", to_ms("start").alias("s"), to_ms("end").alias("e"), "speaker", F.col("cluster_id").alias("cluster"), "text")
    people = table(spark, sf_dir, "roster").select(F.col("campaign_id").alias("campaign"), F.col("discord_username").alias("username"), F.col("character_name").alias("character"), "nicknames", "is_dm")
    clean = clean_turns(turns, people)
    return clean.select(F.col("session").alias("session_id"), F.col("turn_id").cast("int").alias("turn_id"), F.col("person").alias("speaker"), "n_words")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "entities").select(F.col("campaign_id").alias("campaign"), "name", F.col("ord").alias("entity_ord"))
    people = table(spark, sf_dir, "roster").select(F.col("campaign_id").alias("campaign"), F.col("ord").cast("long").alias("person"), F.col("discord_username").alias("username"), F.col("character_name").alias("character"), "nicknames", "is_dm")
    links = link_names(typed, people)
    return typed.join(links, ["campaign", "name"]).select(F.col("person").cast("int").alias("roster_ord"), "entity_ord").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sorted(r[0] for r in table(spark, sf_dir, "lang_codes").select("code").distinct().collect())  # the fixed list of languages
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"))
    found = identify_languages(docs, codes)
    main = found.filter(~F.col("code").eqNullSafe(F.col("lang"))).select(F.col("key").alias("doc_id"), F.lit(0).alias("segment_no"), "lang")
    mixed = found.filter("n_langs > 1").select(F.col("key").alias("doc_id"), F.inline("segments")).select("doc_id", "segment_no", "lang")
    return main.unionByName(mixed)


P3_SQL = """
WITH t AS (
  SELECT DISTINCT session_id, turn_id, CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e,
    regexp_replace(lower(strip_accents(speaker)), '[^\\p{L}\\p{N}]+', '', 'g') AS label
  FROM aligned WHERE speaker IS NOT NULL AND start IS NOT NULL
), u AS (SELECT * FROM t WHERE label <> ''), l AS (
  SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS change FROM u WINDOW w AS (PARTITION BY session_id ORDER BY s, turn_id)
), b AS (SELECT *, sum(change) OVER (PARTITION BY session_id ORDER BY s, turn_id) AS block FROM l), m AS (
  SELECT *, max(e) OVER (PARTITION BY session_id, block ORDER BY s, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM b
), r AS (
  SELECT *, sum(CASE WHEN le IS NULL OR s > le + 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, block ORDER BY s, turn_id) AS run FROM m
)
SELECT session_id, arg_min(turn_id, (s, turn_id)) AS first_turn_id, arg_max(turn_id, (s, turn_id)) AS last_turn_id, count(*) AS n_turns,
  max(e) - min(s) AS duration_ms FROM r GROUP BY session_id, block, run HAVING count(*) >= 2
"""

QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found}

P5_SQL = """
WITH t AS (SELECT DISTINCT session_id, id, CAST(round(start * 1000) AS BIGINT) * 2 AS q FROM diar_turns WHERE start IS NOT NULL),
w AS (
  SELECT DISTINCT session_id, seq, CAST(p AS INTEGER) - 1 AS pos, CAST(round(x.start * 1000) AS BIGINT) + CAST(round(x."end" * 1000) AS BIGINT) AS t
  FROM (SELECT session_id, seq, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS p FROM segments)
  WHERE x.start IS NOT NULL AND x."end" IS NOT NULL
), f AS (SELECT session_id, t, min((seq, pos)) AS r FROM w GROUP BY ALL),
c AS (
  SELECT t.session_id, t.id, f.t AS wt, f.r, abs(f.t - q) AS d FROM t JOIN f ON f.session_id = t.session_id AND f.t BETWEEN q - 500 AND q + 500
), b AS (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY d, wt) AS n FROM c)
SELECT session_id, id, r[1] AS seq, r[2] AS pos FROM b WHERE n = 1
"""

ORACLES = {"p3_found": P3_SQL, "p5_found": P5_SQL}
