from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.operators import turns
from voxframe.operators.vectors import enrol
from voxframe.plans import pipeline
from voxframe.plans.turn_queries import aligned, diar, segments
from voxframe.sources import tables
from voxframe.streaming.live import debounce_stream, enrol_stream, live_slices


def test_run_keeps_all_words(spark, small):
    seg = segments(spark, small).cache()
    names = spark.createDataFrame([], "session_id string, cluster_id string, name string")
    named = pipeline.run(seg, diar(spark, small), names)
    from voxframe.operators.timeline import segment_words

    letters = lambda df, c: df.agg(F.sum(F.length(F.regexp_replace(c, r"\s+", "")))).first()[0]
    assert letters(named, "text") == letters(segment_words(seg), "word")
    assert pipeline.transcripts(named).count() == named.select("session_id").distinct().count()


def test_multitrack(spark):
    rows = [("s", "1-merrow1", 0, 10.0), ("s", "1-merrow1", 1, 0.0), ("s", "2-TESSARO", 0, 1.5), ("s", "10-carol", 0, 0.5), ("s", "stranger", 0, 5.0)]
    tracks = spark.createDataFrame([(s, t, q, int(x * 1000), int(x * 1000) + 100, f"t{x}") for s, t, q, x in rows], "session_id string, track_id string, seq int, start_ms long, end_ms long, text string")
    roster = spark.createDataFrame([("merrow1", "Merrow"), ("tessaro", "MJ"), ("carol", "Lyra")], "username string, character_name string")
    got = [r.speaker for r in pipeline.multitrack(tracks, roster).orderBy("start_ms").collect()]
    assert got == ["Merrow (merrow1)", "Lyra (carol)", "MJ (tessaro)", "stranger", "Merrow (merrow1)"]


def test_recluster_matches(spark):
    e = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [0.9, 0.1]), ("s", 2, [0.0, 1.0])], "session_id string, id long, vector array<double>")
    p = spark.createDataFrame([(0, "A", [1.0, 0.0]), (1, "B", [0.0, 1.0])], "ord int, speaker string, vector array<double>")
    assert {(r.label, r.name) for r in pipeline.recluster(e, p).collect()} == {("SPEAKER_00", "A"), ("SPEAKER_01", "B")}


def test_streams_equal_batch(spark, small, tmp_path):
    rows = aligned(spark, small).filter("trim(text) <> ''").withColumn("ingested_at", F.timestamp_millis(F.col("start_ms")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    last = rows.groupBy("session_id").agg((F.max("start_ms") + 10_000_000_000).alias("start_ms"))
    end = last.select("session_id", F.lit(10**6).alias("turn_id"), "start_ms", F.col("start_ms").alias("end_ms"), F.lit("end").alias("speaker"), F.lit("x").alias("text"), F.timestamp_millis("start_ms").alias("ingested_at"))
    wanted = "session_id string, turn_id long, start_ms long, end_ms long, speaker string, text string, ingested_at timestamp"
    rows.select(*[c.split()[0] for c in wanted.split(", ")]).unionByName(end).selectExpr("session_id", "cast(turn_id as long) turn_id", "start_ms", "end_ms", "speaker", "text", "ingested_at").coalesce(1).write.parquet(str(tmp_path / "stream"))
    source = spark.readStream.schema(wanted).parquet(str(tmp_path / "stream"))
    query = debounce_stream(source).writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda df: sorted((r.session_id, r.turn_id, r.start_ms, r.end_ms, r.text) for r in df.filter("speaker is null or speaker <> 'end'").collect())
    assert key(spark.table("merged")) == key(turns.debounce(rows))
    slices = live_slices(source).writeStream.format("memory").queryName("slices").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    slices.awaitTermination(120)
    assert spark.table("slices").agg(F.sum("n_turns")).first()[0] == rows.count() + last.count()


def test_enrolment_stream(spark, tmp_path):
    samples = spark.createDataFrame([("A", "1", [1.0, 0.0]), ("A", "2", [0.8, 0.6]), ("B", "3", [0.0, 1.0])], "speaker string, sample_id string, vector array<double>")
    samples.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in"))
    enrol_stream(stream, str(tmp_path / "p"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    none = spark.createDataFrame([], "speaker string, centroid array<double>, sample_count long, sample_ids array<string>")
    want = {(r.speaker, r.sample_count) for r in enrol(samples, none).collect()}
    assert {(r.speaker, r.sample_count) for r in spark.read.parquet(str(tmp_path / "p" / "v1.parquet")).collect()} == want


def test_file_sources(spark, tmp_path):
    (tmp_path / "notes" / "deep").mkdir(parents=True)
    (tmp_path / "notes" / "deep" / "a.md").write_bytes(b"## Name\nbad \xff byte")
    (tmp_path / "notes" / "b.txt").write_text("no")
    assert tables.read_notes(spark, str(tmp_path / "notes")).first().text.startswith("## Name")
    assert {len(r.hash) for r in tables.file_hashes(spark, str(tmp_path / "notes")).collect()} == {16}
    (tmp_path / "words.txt").write_text("# c\n\n Alpha \n")
    assert [r.name for r in tables.read_word_list(spark, str(tmp_path / "words.txt")).collect()] == ["Alpha"]
    (tmp_path / "p.json").write_text('{"speakers": {"A": {"centroid": [1.0], "sample_count": 2}}}')
    assert [(r.speaker, r.sample_count, r.sample_ids) for r in tables.read_voice_profiles(spark, str(tmp_path / "p.json")).collect()] == [("A", 2, [])]
    df = spark.createDataFrame([("h", 1), ("i", 2)], "media_hash string, n int")
    tables.save_by_media(df, str(tmp_path / "store"))
    tables.save_by_media(df.filter("n = 2").withColumn("n", F.lit(5)), str(tmp_path / "store"))
    assert {(r.media_hash, r.n) for r in spark.read.parquet(str(tmp_path / "store")).collect()} == {("h", 1), ("i", 5)}
