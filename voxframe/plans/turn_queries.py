"""Queries over turns, words and their alignment, with SQL counterparts. All times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.timeexpr import format_timestamp, parse_timestamp, to_ms
from voxframe.operators import attribution, timeline, turns
from voxframe.session import table
from voxframe.sources.render import render_markdown


def aligned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "aligned").select("session_id", "seq", "turn_id", "source_turn_id", F.col("speaker_uncertain").alias("uncertain"), to_ms("start").alias("start_ms"), to_ms("end").alias("end_ms"), "speaker", "cluster_id", "text", "time_slice_id")
    return rows.filter("start_ms is not null and end_ms is not null").dropDuplicates(["session_id", "turn_id"])


def diar(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "diar_turns").select("session_id", "seq", "id", to_ms("start").alias("start_ms"), to_ms("end").alias("end_ms"), "cluster_id", "resolved_speaker", "flagged")
    return rows.filter("start_ms is not null and end_ms is not null").dropDuplicates(["session_id", "id"])


def segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("session_id", "seq", to_ms("start").alias("start_ms"), to_ms("end").alias("end_ms"), "text", "words")
    return rows.filter("start_ms is not null and end_ms is not null").dropDuplicates(["session_id", "seq"])


AL = """al AS (SELECT DISTINCT session_id, seq, turn_id, source_turn_id, speaker_uncertain AS uncertain, CAST(round(start * 1000) AS BIGINT) AS start_ms,
  CAST(round("end" * 1000) AS BIGINT) AS end_ms, speaker, cluster_id, text, time_slice_id FROM aligned WHERE start IS NOT NULL AND "end" IS NOT NULL)"""
DI = """di AS (SELECT DISTINCT session_id, seq, id, CAST(round(start * 1000) AS BIGINT) AS start_ms, CAST(round("end" * 1000) AS BIGINT) AS end_ms, cluster_id,
  resolved_speaker, flagged FROM diar_turns WHERE start IS NOT NULL AND "end" IS NOT NULL)"""
SE = """se AS (SELECT * FROM (SELECT session_id, seq, CAST(round(start * 1000) AS BIGINT) AS start_ms, CAST(round("end" * 1000) AS BIGINT) AS end_ms, text, words,
  row_number() OVER (PARTITION BY session_id, seq) AS rn FROM segments WHERE start IS NOT NULL AND "end" IS NOT NULL) WHERE rn = 1)"""
WO = (
    SE
    + """, w0 AS (SELECT session_id, seq, unnest(words) AS x, unnest(range(len(words))) AS pos FROM se WHERE len(words) > 0),
wo AS (SELECT session_id, seq, CAST(pos AS INTEGER) AS pos, x.word AS word, CAST(round(x.start * 1000) AS BIGINT) AS start_ms, CAST(round(x."end" * 1000) AS BIGINT) AS end_ms
  FROM w0 WHERE x.start IS NOT NULL AND x."end" IS NOT NULL
  UNION ALL SELECT session_id, seq, 0, text, start_ms, end_ms FROM se WHERE words IS NULL OR len(words) = 0)"""
)
GR = (
    WO
    + """, lw AS (SELECT *, lag(word) OVER o AS pw, lag(end_ms) OVER o AS pe FROM wo WINDOW o AS (PARTITION BY session_id ORDER BY start_ms, seq, pos)),
lg AS (SELECT session_id, seq, pos, word, start_ms, end_ms, sum(CASE WHEN coalesce(start_ms - pe <= 200 AND (regexp_matches(trim(word), '^[''’‐‑-]')
  OR (length(trim(word)) > 0 AND NOT regexp_matches(trim(word), '[\\p{L}\\p{N}]')) OR regexp_matches(rtrim(pw), '[''’‐‑-]$')), false) THEN 0 ELSE 1 END)
  OVER (PARTITION BY session_id ORDER BY start_ms, seq, pos) AS group_no FROM lw)"""
)
MATCH = (
    GR
    + ", "
    + DI
    + """, t AS (SELECT session_id, id, cluster_id, start_ms AS ts, end_ms AS te FROM di WHERE end_ms > start_ms),
g AS (SELECT session_id, group_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(trim(word), '' ORDER BY start_ms, seq, pos) AS text, arg_min(end_ms, (start_ms, seq, pos)) = min(start_ms) AS point FROM lg GROUP BY ALL),
p AS (SELECT lg.session_id, group_no, id, cluster_id, ts, te, sum(greatest(0, least(end_ms, te) - greatest(start_ms, ts))) AS ov FROM lg JOIN t ON lg.session_id = t.session_id
  AND ((least(end_ms, te) - greatest(start_ms, ts) > 0 AND end_ms >= start_ms) OR (start_ms = end_ms AND start_ms BETWEEN ts AND te)) GROUP BY ALL),
r AS (SELECT p.*, row_number() OVER (PARTITION BY p.session_id, group_no ORDER BY ov DESC, abs(ts + te - g.start_ms - g.end_ms), ts, id, cluster_id) AS n FROM p JOIN g USING (session_id, group_no)),
u AS (SELECT session_id, group_no, count(DISTINCT cluster_id) > 1 AS uncertain FROM p GROUP BY ALL),
lost AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.session_id = g.session_id AND p.group_no = g.group_no AND ov > 0)),
hd AS (SELECT l.session_id, l.group_no, id, cluster_id, row_number() OVER (PARTITION BY l.session_id, l.group_no ORDER BY abs(ts + te - l.start_ms - l.end_ms), ts, id, cluster_id) AS n FROM lost l JOIN t ON t.session_id = l.session_id
  AND l.point AND ts * 2 <= l.start_ms + l.end_ms AND l.start_ms + l.end_ms <= te * 2),
nb AS (SELECT l.session_id, l.group_no, arg_max((te * 2, t.ts, id, cluster_id), (te, -t.ts, -id)) AS x FROM lost l JOIN t ON t.session_id = l.session_id AND te * 2 <= l.start_ms + l.end_ms GROUP BY ALL),
na AS (SELECT l.session_id, l.group_no, arg_min((ts * 2, t.ts, id, cluster_id), (ts, t.ts, id)) AS x FROM lost l JOIN t ON t.session_id = l.session_id AND ts * 2 >= l.start_ms + l.end_ms GROUP BY ALL),
nn AS (SELECT session_id, group_no, l.start_ms + l.end_ms AS m, x FROM lost l JOIN (SELECT * FROM nb UNION ALL SELECT * FROM na) USING (session_id, group_no)),
nr AS (SELECT session_id, group_no, x[3] AS id, x[4] AS cluster_id, row_number() OVER (PARTITION BY session_id, group_no ORDER BY abs(x[1] - m), x[2], x[3]) AS n FROM nn),
aw AS (SELECT g.* EXCLUDE (point), coalesce(r.id, hd.id, nr.id) AS turn_id, coalesce(r.cluster_id, hd.cluster_id, nr.cluster_id) AS cluster_id, coalesce(uncertain, false) AS uncertain FROM g
  LEFT JOIN r ON r.session_id = g.session_id AND r.group_no = g.group_no AND r.n = 1 AND r.ov > 0 LEFT JOIN hd ON hd.session_id = g.session_id AND hd.group_no = g.group_no AND hd.n = 1 LEFT JOIN u ON u.session_id = g.session_id AND u.group_no = g.group_no
  LEFT JOIN nr ON nr.session_id = g.session_id AND nr.group_no = g.group_no AND nr.n = 1)"""
)
#: Names that the queries take from the tables: of turns every tenth, of slices the even ones, of clusters the first real speaker.
NAMES = """tn AS (SELECT session_id, turn_id, speaker AS name FROM al WHERE turn_id % 10 = 0 AND speaker IS NOT NULL),
sn AS (SELECT session_id, time_slice_id, cluster_id, min(speaker) AS name FROM al WHERE time_slice_id % 2 = 0 AND cluster_id IS NOT NULL AND speaker IS NOT NULL GROUP BY ALL),
cn AS (SELECT session_id, cluster_id, min(speaker) AS name FROM al WHERE cluster_id IS NOT NULL AND speaker IS NOT NULL AND seq % 3 = 0 GROUP BY ALL)"""


def _names(al: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = al.filter("speaker is not null")
    own = named.filter("turn_id % 10 = 0").select("session_id", "turn_id", F.col("speaker").alias("name"))
    clustered = named.filter("cluster_id is not null")
    in_slice = clustered.filter("time_slice_id % 2 = 0").groupBy("session_id", "time_slice_id", "cluster_id").agg(F.min("speaker").alias("name"))
    default = clustered.filter("seq % 3 = 0").groupBy("session_id", "cluster_id").agg(F.min("speaker").alias("name"))
    return own, in_slice, default


def q_time_slices(s, d):
    return timeline.time_slices(aligned(s, d), 5).select("session_id", "turn_id", "time_slice_id")


def q_cluster_split(s, d):
    return timeline.split_cluster(aligned(s, d), "SPEAKER_00", 600_000, "SPEAKER_99").select("session_id", "turn_id", "cluster_id")


def q_split_chain(s, d):
    al = aligned(s, d)
    one = F.struct(F.lit(0).alias("seq"), F.lit("SPEAKER_00").alias("cluster_id"), F.lit(300_000).cast("long").alias("at_ms"), F.lit("X").alias("new_cluster_id"))
    two = F.struct(F.lit(1).alias("seq"), F.lit("X").alias("cluster_id"), F.lit(900_000).cast("long").alias("at_ms"), F.lit("Y").alias("new_cluster_id"))
    splits = al.select("session_id").distinct().select("session_id", F.inline(F.array(one, two)))
    return timeline.apply_splits(al, splits).select("session_id", "turn_id", "cluster_id")


def q_flagged(s, d):
    return diar(s, d).filter("flagged").select("session_id", "id", "cluster_id")


def q_long_clips(s, d):
    return timeline.long_clips(diar(s, d)).select("session_id", "id", "n_samples")


def q_untimed(s, d):
    return timeline.untimed_turns(segments(s, d)).select("session_id", "turn_id", "start_ms", "cluster_id", "text")


def q_segment_words(s, d):
    return timeline.segment_words(segments(s, d))


def q_lexical_groups(s, d):
    return timeline.lexical_groups(timeline.segment_words(segments(s, d))).select("session_id", "seq", "pos", "group_no")


def _aligned_words(s, d):
    return timeline.align_words(timeline.segment_words(segments(s, d)), diar(s, d))


def q_align_words(s, d):
    return _aligned_words(s, d)


def q_aligned_runs(s, d):
    runs = timeline.aligned_runs(_aligned_words(s, d).filter("turn_id is not null"))
    return runs.select("session_id", "run_no", "run_id", "source_turn_id", "start_ms", "end_ms", "cluster_id", "text", "uncertain")


def q_interleave(s, d):
    tracks = aligned(s, d).filter("speaker is not null").select("session_id", F.col("speaker").alias("track_id"), F.col("turn_id").alias("seq"), "start_ms")
    return turns.interleave(tracks)


def _debounced(s, d):
    return turns.debounce(aligned(s, d).filter("trim(text) <> ''"))


def q_debounce(s, d):
    return _debounced(s, d)


def q_render(s, d):
    return render_markdown(_debounced(s, d))


def q_cluster_stats(s, d):
    return turns.cluster_stats(aligned(s, d).filter("cluster_id is not null and text is not null")).drop("samples")


def q_cluster_samples(s, d):
    stats = turns.cluster_stats(aligned(s, d).filter("cluster_id is not null and text is not null"))
    return stats.select("session_id", "cluster_id", F.array_join("samples", "|").alias("samples"))


def q_first_appearance(s, d):
    return turns.first_appearance_labels(aligned(s, d)).select("session_id", "turn_id", "label")


def q_carry(s, d):
    rows = diar(s, d).select("session_id", F.col("id").alias("turn_id"), "start_ms", F.col("resolved_speaker").alias("label"))
    return turns.carry_labels(rows)


def q_session_figures(s, d):
    return turns.session_figures(diar(s, d).withColumnRenamed("id", "turn_id"))


def q_mapping_apply(s, d):
    al = aligned(s, d)
    return attribution.apply_mapping(al, *_names(al)).select("session_id", "turn_id", "speaker")


def q_label_propagation(s, d):
    al = aligned(s, d)
    own, _, default = _names(al)
    return attribution.propagate_labels(al, own, default)


def q_insert_absent(s, d):
    al = aligned(s, d)
    default = _names(al)[2].withColumn("source", F.lit("manual"))
    matches = al.filter("cluster_id is not null and speaker is not null").groupBy("session_id", "cluster_id").agg(F.max("speaker").alias("name"))
    return attribution.insert_absent(default, matches)


def q_may_enrol(s, d):
    names = _names(aligned(s, d))[2].withColumn("source", F.when(F.length("name") % 2 == 0, F.lit("profile_match")))
    return attribution.may_enrol(attribution.manual_sources(names))


def q_review(s, d):
    al = aligned(s, d).filter("cluster_id is not null and text is not null")
    return attribution.review_clusters(turns.cluster_stats(al), _names(al)[2], 5, 20_000).select("session_id", "cluster_id", "n_turns", "total_ms", "name")


def q_timestamp(s, d):
    text = format_timestamp(F.col("start_ms") / 1000)
    return diar(s, d).select("session_id", "id", text.alias("at"), parse_timestamp(text).cast("long").alias("seconds"))


QUERIES = {
    "time_slices": q_time_slices, "cluster_split": q_cluster_split, "split_chain": q_split_chain, "flagged_turns": q_flagged, "long_clips": q_long_clips, "untimed_fallback": q_untimed,
    "segment_words": q_segment_words, "lexical_groups": q_lexical_groups, "align_words": q_align_words, "aligned_runs": q_aligned_runs, "interleave": q_interleave, "debounce": q_debounce,
    "render_turns": q_render, "cluster_stats": q_cluster_stats, "cluster_samples": q_cluster_samples, "first_appearance_labels": q_first_appearance, "short_label_carry": q_carry,
    "session_figures": q_session_figures, "speaker_mapping_apply": q_mapping_apply, "label_propagation": q_label_propagation, "insert_absent_mapping": q_insert_absent,
    "enrolment_gate": q_may_enrol, "review_filter": q_review, "timestamp_format_parse": q_timestamp,
}



def debounce_sql(source: str) -> str:
    """Merged turns ``de`` of the rows of a source."""
    return f"""a AS (SELECT *, CASE WHEN row_number() OVER o > 1 AND lag(speaker) OVER o IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS c FROM {source}
  WINDOW o AS (PARTITION BY session_id ORDER BY start_ms, turn_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY start_ms, turn_id) AS isl FROM a),
e AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id, isl ORDER BY start_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM b),
f AS (SELECT *, sum(CASE WHEN le IS NULL OR start_ms - le > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, isl ORDER BY start_ms, turn_id) AS grp FROM e),
de AS (SELECT session_id, arg_min(turn_id, (start_ms, turn_id)) AS turn_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(speaker) AS speaker,
  trim(string_agg(text, ' ' ORDER BY start_ms, turn_id)) AS text, bool_or(uncertain) AS uncertain, count(*) AS n_turns FROM f GROUP BY session_id, isl, grp)"""


DEBOUNCE = f"{AL}, x AS (SELECT * FROM al WHERE trim(text) <> ''), {debounce_sql('x')}"
#: Runs of aligned groups of one turn.
RUNS = """k AS (SELECT * FROM aw WHERE turn_id IS NOT NULL), y AS (SELECT *, CASE WHEN lag(turn_id) OVER o = turn_id THEN 0 ELSE 1 END AS c FROM k WINDOW o AS (PARTITION BY session_id ORDER BY start_ms, group_no)),
z AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY start_ms, group_no) AS run_no FROM y),
q AS (SELECT session_id, run_no, any_value(turn_id) AS source_turn_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(cluster_id) AS cluster_id, string_agg(text, ' ' ORDER BY start_ms, group_no) AS text, bool_or(uncertain) AS uncertain FROM z GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY session_id, source_turn_id ORDER BY run_no) > 1 AS again FROM q),
ru AS (SELECT session_id, run_no, CASE WHEN again THEN max(source_turn_id) OVER (PARTITION BY session_id) + sum(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY run_no) ELSE source_turn_id END AS run_id,
  source_turn_id, start_ms, end_ms, cluster_id, text, uncertain FROM v)"""
STAMP = "printf('%02d:%02d:%02d', greatest(0, {0}) // 3600000, greatest(0, {0}) // 60000 % 60, greatest(0, {0}) // 1000 % 60)"

ORACLES = {
    "time_slices": f"WITH {AL} SELECT session_id, turn_id, CAST(start_ms // 300000 AS INTEGER) AS time_slice_id FROM al",
    "cluster_split": f"WITH {AL} SELECT session_id, turn_id, CASE WHEN cluster_id = 'SPEAKER_00' AND start_ms >= 600000 THEN 'SPEAKER_99' ELSE cluster_id END AS cluster_id FROM al",
    "split_chain": f"WITH {AL} SELECT session_id, turn_id, CASE WHEN cluster_id = 'SPEAKER_00' AND start_ms >= 900000 THEN 'Y' WHEN cluster_id = 'SPEAKER_00' AND start_ms >= 300000 THEN 'X' ELSE cluster_id END AS cluster_id FROM al",
    "flagged_turns": f"WITH {DI} SELECT session_id, id, cluster_id FROM di WHERE flagged",
    "long_clips": f"WITH {DI}, n AS (SELECT session_id, id, end_ms * 16000 // 1000 - greatest(0, start_ms * 16000 // 1000) AS n_samples FROM di) SELECT * FROM n WHERE n_samples >= 2400",
    "untimed_fallback": f"WITH {SE} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, seq) - 1 AS turn_id, start_ms, 'SPEAKER_00' AS cluster_id, text FROM se",
    "segment_words": f"WITH {WO} SELECT * FROM wo",
    "lexical_groups": f"WITH {GR} SELECT session_id, seq, pos, group_no FROM lg",
    "align_words": f"WITH {MATCH} SELECT * FROM aw",
    "aligned_runs": f"WITH {MATCH}, {RUNS} SELECT * FROM ru",
    "interleave": f"WITH {AL} SELECT session_id, speaker AS track_id, turn_id AS seq, start_ms, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, speaker, turn_id) - 1 AS turn_id FROM al WHERE speaker IS NOT NULL",
    "debounce": f"WITH {DEBOUNCE} SELECT * FROM de",
    "render_turns": f"""WITH {DEBOUNCE} SELECT session_id, CASE WHEN bool_or(uncertain) THEN '> [!WARNING] Some speaker attributions are uncertain. Review speaker assignments against the audio.' || chr(10) || chr(10) ELSE '' END ||
  rtrim(regexp_replace(string_agg('### [' || {STAMP.format("start_ms")} || ' - ' || {STAMP.format("end_ms")} || '] ' || coalesce(speaker, '') || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY start_ms, turn_id), '\\n+$', '')) || chr(10) AS markdown FROM de GROUP BY session_id""",
    "cluster_stats": f"WITH {AL} SELECT session_id, cluster_id, count(*) AS n_turns, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, min(seq) AS first_seq FROM al WHERE cluster_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL",
    "cluster_samples": f"WITH {AL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY seq, turn_id) AS n FROM al WHERE cluster_id IS NOT NULL AND text IS NOT NULL) SELECT session_id, cluster_id, string_agg(text, '|' ORDER BY seq, turn_id) AS samples FROM r WHERE n <= 4 GROUP BY ALL",
    "first_appearance_labels": f"WITH {AL}, f AS (SELECT session_id, cluster_id, min((seq, turn_id)) AS k FROM al WHERE cluster_id IS NOT NULL GROUP BY ALL), l AS (SELECT *, printf('SPEAKER_%02d', row_number() OVER (PARTITION BY session_id ORDER BY k) - 1) AS label FROM f) SELECT al.session_id, turn_id, label FROM al LEFT JOIN l ON l.session_id = al.session_id AND l.cluster_id = al.cluster_id",
    "short_label_carry": f"WITH {DI}, c AS (SELECT session_id, id AS turn_id, start_ms, resolved_speaker AS label, last_value(resolved_speaker IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(resolved_speaker IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start_ms, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM di) SELECT session_id, turn_id, start_ms, label, coalesce(b, f) AS carried FROM c",
    "session_figures": f"WITH {DI} SELECT session_id, max(end_ms - start_ms) AS max_turn_ms, max(id) AS max_id, max(end_ms) AS last_end_ms, count(DISTINCT cluster_id) AS n_speakers FROM di GROUP BY ALL",
    "speaker_mapping_apply": f"""WITH {AL}, {NAMES} SELECT al.session_id, al.turn_id, coalesce(o.name, s.name, sn.name, cn.name, CASE WHEN speaker <> '' AND speaker <> al.cluster_id THEN speaker END, al.cluster_id) AS speaker FROM al
  LEFT JOIN tn o ON o.session_id = al.session_id AND o.turn_id = al.turn_id LEFT JOIN tn s ON s.session_id = al.session_id AND s.turn_id = al.source_turn_id
  LEFT JOIN sn ON sn.session_id = al.session_id AND sn.time_slice_id = al.time_slice_id AND sn.cluster_id = al.cluster_id LEFT JOIN cn ON cn.session_id = al.session_id AND cn.cluster_id = al.cluster_id""",
    "label_propagation": f"""WITH {AL}, {NAMES}, j AS (SELECT al.session_id, al.turn_id, start_ms, coalesce(nullif(o.name, ''), nullif(cn.name, ''), al.cluster_id) AS n FROM al LEFT JOIN tn o ON o.session_id = al.session_id AND o.turn_id = al.turn_id
  LEFT JOIN cn ON cn.session_id = al.session_id AND cn.cluster_id = al.cluster_id), r AS (SELECT *, CASE WHEN NOT starts_with(n, 'SPEAKER_') THEN n END AS real FROM j),
f AS (SELECT *, coalesce(last_value(real IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(real IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start_ms, turn_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS name FROM r)
SELECT session_id, turn_id, name FROM f WHERE real IS NULL AND name IS NOT NULL""",
    "insert_absent_mapping": f"WITH {AL}, {NAMES}, m AS (SELECT session_id, cluster_id, max(speaker) AS name FROM al WHERE cluster_id IS NOT NULL AND speaker IS NOT NULL GROUP BY ALL) SELECT session_id, cluster_id, name, 'manual' AS source FROM cn UNION ALL SELECT session_id, cluster_id, name, 'profile_match' FROM m ANTI JOIN cn USING (session_id, cluster_id)",
    "enrolment_gate": f"WITH {AL}, {NAMES}, s AS (SELECT *, CASE WHEN length(name) % 2 = 0 THEN 'profile_match' WHEN NOT starts_with(name, 'SPEAKER_') THEN 'manual' END AS source FROM cn) SELECT session_id, coalesce(bool_or(source = 'manual' AND NOT starts_with(name, 'SPEAKER_')), false) AS may_enrol FROM s GROUP BY ALL",
    "review_filter": f"WITH {AL}, {NAMES}, s AS (SELECT session_id, cluster_id, count(*) AS n_turns, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM al WHERE cluster_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL), c2 AS (SELECT session_id, cluster_id, min(speaker) AS name FROM al WHERE cluster_id IS NOT NULL AND speaker IS NOT NULL AND text IS NOT NULL AND seq % 3 = 0 GROUP BY ALL) SELECT session_id, cluster_id, n_turns, total_ms, name FROM s LEFT JOIN c2 USING (session_id, cluster_id) WHERE n_turns >= 5 AND total_ms >= 20000",
    "timestamp_format_parse": f"WITH {DI} SELECT session_id, id, {STAMP.format('start_ms')} AS at, greatest(0, start_ms) // 1000 AS seconds FROM di",
}
