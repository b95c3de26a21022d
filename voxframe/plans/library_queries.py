"""Queries over vectors, notes, chunks, provenance and files, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.dice import dice_notation
from voxframe.operators import attribution, glossary, lore, provenance, refine, vectors
from voxframe.plans import pipeline
from voxframe.plans.turn_queries import AL, DI, MATCH, RUNS, SE, aligned, debounce_sql, diar, segments
from voxframe.session import cut, table
from voxframe.sources import tables


def _embeddings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))


def _profiles(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "profiles").filter("size(centroid) = 64 and not exists(centroid, x -> x is null) and exists(centroid, x -> x <> 0)")
    return rows.dropDuplicates(["ord"]).select("ord", "speaker", F.col("centroid").alias("vector"))


def _means(s, d):
    return vectors.mean_vectors(_embeddings(s, d), ["label"], "vector").select(F.col("label").alias("query"), F.col("mean").alias("vector"))


def q_centroids(s, d):
    mean = vectors.mean_vectors(_embeddings(s, d), ["label"], "vector")
    return mean.withColumn("mean", vectors.unit(F.col("mean"))).select("label", "n", F.posexplode("mean").alias("pos", "x")).withColumn("x", F.round("x", 6))


def q_match_open(s, d):
    return vectors.best_profiles(_means(s, d), _profiles(s, d), 0.3).select("query", "ord", F.round("cosine", 6).alias("cosine"))


def q_classify_closed(s, d):
    return vectors.best_profiles(_means(s, d), _profiles(s, d), None).select("query", "ord", F.round("cosine", 6).alias("cosine"))


def q_classify_allowed(s, d):
    allowed = table(s, d, "roster").select(F.col("character_name").alias("speaker"))
    return vectors.best_profiles(_means(s, d), _profiles(s, d), None, allowed).select("query", "ord", F.round("cosine", 6).alias("cosine"))


def _samples(s, d):
    rows = _embeddings(s, d).select(F.col("label").alias("speaker"), F.col("vec_id").cast("string").alias("sample_id"), "vector")
    return rows, s.createDataFrame([], "speaker string, centroid array<double>, sample_count long, sample_ids array<string>")


def _enrolled(s, d):
    rows, none = _samples(s, d)
    return rows, cut(vectors.enrol(rows.filter("sample_id % 2 = 0"), none))


def _flat(p):
    return p.select("speaker", "sample_count", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


def q_enrol(s, d):
    rows, old = _enrolled(s, d)
    return _flat(vectors.enrol(rows, old))


def q_enrol_again(s, d):
    rows, old = _enrolled(s, d)
    return _flat(vectors.enrol(rows.filter("sample_id % 2 = 0"), old))


def q_enrol_all_again(s, d):
    rows, none = _samples(s, d)
    return _flat(vectors.enrol(rows, cut(vectors.enrol(rows, none))))


def q_unsafe(s, d):
    return vectors.unsafe_sources(aligned(s, d))


def q_representative(s, d):
    return vectors.representative_runs(aligned(s, d))


def q_recluster(s, d):
    return vectors.recluster(_embeddings(s, d).select(F.col("label").alias("session_id"), F.col("vec_id").alias("id"), "vector"), None, 0.9)


def _notes(s, d):
    return table(s, d, "documents").select("doc_id", "text", "source")


def q_entities(s, d):
    return lore.extract_entities(_notes(s, d))


def q_priority(s, d):
    return table(s, d, "entities").dropDuplicates(["ord"]).select("ord", lore.priority(F.col("kind")).alias("priority"))


def q_names(s, d):
    roster = table(s, d, "roster").select("campaign_id", F.col("character_name").alias("name"), "ord")
    return lore.ordered_distinct(roster, table(s, d, "entities").select("campaign_id", "name", "ord"))


def q_prompt(s, d):
    return lore.biasing_prompt(table(s, d, "entities").select("campaign_id", "ord", "name", "kind").distinct())


def q_control(s, d):
    return _notes(s, d).filter("text is not null").select("doc_id", F.md5(lore.strip_control_tokens(F.col("text"))).alias("digest"))


def q_lines(s, d):
    return cut(lore.visible_lines(_notes(s, d)))


def q_ownership(s, d):
    return lore.owned_lines(q_lines(s, d)).groupBy("doc_id").agg(F.sum("n").alias("n_lines"))


def q_terms(s, d):
    return lore.term_frequencies(q_lines(s, d))


def q_terms_unknown(s, d):
    spoken = table(s, d, "segments").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(lore.WORD), F.lit(0))).alias("term"))
    return lore.term_frequencies(q_lines(s, d), spoken)


def q_aliases(s, d):
    rows = table(s, d, "roster").select(F.explode("nicknames").alias("alias"), F.col("character_name").alias("name"))
    return lore.unique_aliases(rows)


def q_pack(s, d):
    ranked = table(s, d, "entities").filter("name is not null").groupBy("campaign_id", F.col("name").alias("term")).agg((-F.count_distinct("ord")).alias("rank"))
    return lore.pack_reference(ranked, ["campaign_id"], 1500).select("campaign_id", F.array_join("terms", "|").alias("terms"), "n_chars")


def q_dice(s, d):
    return aligned(s, d).filter("text is not null").select("session_id", "turn_id", dice_notation("text").alias("text"))


def _md_turns(s, d):
    rows = table(s, d, "documents").filter("kind = 'transcript'")
    return cut(refine.parse_turns(rows.select("doc_id", "text")))


def q_md_turns(s, d):
    return _md_turns(s, d).select("doc_id", "turn_no", "speaker", "word_start", "word_end")


def q_word_chunks(s, d):
    return refine.word_chunks(_md_turns(s, d), 20).select("doc_id", "chunk_no", "turn_no", "word_start", "word_end")


def q_turn_chunks(s, d):
    return refine.turn_chunks(_md_turns(s, d), 5).groupBy("doc_id", "chunk_no").agg(F.count("*").alias("n_turns"))


def q_coverage(s, d):
    return refine.covers(refine.word_chunks(_md_turns(s, d), 20))


def q_headers(s, d):
    found = table(s, d, "documents").filter("text is not null").select("doc_id", refine.headers(F.col("text")).alias("h"))
    return found.select("doc_id", F.size("h").alias("n_headers"), F.array_join("h", "|").alias("headers"))


def q_reasons(s, d):
    rows = table(s, d, "documents").filter("kind = 'transcript' and text is not null").select("doc_id", "text")
    kind = F.col("doc_id") % 4
    edited = F.when(kind == 0, F.col("text")).when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", r"### \[", "### (")).otherwise(F.concat("text", F.repeat(F.lit(" x"), 200)))
    return rows.select("doc_id", refine.rejection(F.col("text"), edited).alias("reason"))


def q_envelopes(s, d):
    turns = _md_turns(s, d)
    pieces = refine.word_chunks(turns, 20).groupBy("doc_id", F.col("chunk_no").alias("piece_no")).agg(F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end"))
    return refine.envelopes(pieces, turns)


def q_callouts(s, d):
    """Every text as it stands, put into a callout."""
    text = F.concat(F.lit("> [!note] x\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.md5(refine.strip_callouts(text)).alias("digest"))


def q_callouts_all(s, d):
    wrapped = F.concat(F.lit("> [!note] x\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.md5(refine.strip_callouts(F.col("text"))).alias("digest"), F.md5(refine.strip_callouts(wrapped)).alias("wrapped_digest"))


def _stored(s, d):
    rows = diar(s, d).groupBy("session_id").agg(F.count("*").alias("n"), F.max("end_ms").alias("m"))
    return rows.select(F.col("session_id").alias("media_hash"), F.when(F.col("n") % 3 == 0, "auto").when(F.col("n") % 3 == 1, "nemotron").otherwise("ecapa").alias("engine"), F.when(F.col("n") % 2 == 0, "ecapa").alias("resolved_engine"), F.lit("large").alias("model_name"), F.lit("fp16").alias("compute_type"), F.lit("no_prompt").alias("prompt_hash"), F.lit("fr").alias("language"), F.when(F.col("m") % 2 == 0, "cuda").otherwise("cpu").alias("device"), F.lit(0.6).alias("threshold"), F.lit(None).cast("int").alias("num_speakers"), F.when(F.col("m") % 3 > 0, F.lit("t")).alias("transcript_hash"))


def q_transcript_hit(s, d):
    stored = _stored(s, d)
    return provenance.transcript_hits(stored, stored.withColumn("engine", F.lit("ecapa")).drop("device")).select("media_hash", "engine")


def q_diarization_hit(s, d):
    stored = _stored(s, d)
    wanted = stored.withColumns({"engine": F.lit("auto"), "resolved_engine": F.lit("ecapa"), "device": F.lit("cuda"), "transcript_hash": F.lit("t")})
    return stored.alias("s").join(wanted.alias("e"), (F.col("s.media_hash") == F.col("e.media_hash")) & provenance.diarization_usable(), "left_semi").select("media_hash", "engine")


def q_embedding_hit(s, d):
    rows = diar(s, d).select(F.col("session_id").alias("media_hash"))
    recorded = diar(s, d).groupBy(F.col("session_id").alias("media_hash")).agg((F.count("*") - F.max("id") % 2).alias("count"), F.lit("t").alias("transcript_hash"))
    return provenance.complete_embeddings(recorded, rows).select("media_hash", "count")


def q_embeddings_reuse(s, d):
    """Embeddings of turns and segments recorded with the number of rows, every other one with one more; expected are those of the ECAPA model."""
    rows = diar(s, d).select(F.col("session_id").alias("media_hash"), F.lit("turn").alias("entity_kind")).unionByName(segments(s, d).select(F.col("session_id").alias("media_hash"), F.lit("segment").alias("entity_kind")))
    counted = rows.groupBy("media_hash", "entity_kind").agg(F.count("*").alias("n"))
    model = F.when(F.col("n") % 3 == 0, "other").otherwise("ecapa").alias("model")
    stored = counted.select("media_hash", "entity_kind", model, F.when(F.col("n") % 5 > 0, F.lit("h")).alias("source_hash"), F.md5("media_hash").alias("fingerprint"), (F.col("n") + F.col("n") % 2).alias("count"))
    return provenance.usable_embeddings(stored, stored.withColumn("model", F.lit("ecapa")), rows).select("media_hash", "entity_kind", "count")


def q_row_hash(s, d):
    return aligned(s, d).select("session_id", "turn_id", "start_ms", provenance.row_hash(["turn_id", "session_id", "start_ms"]).alias("hash"))


def q_label_sources(s, d):
    names = aligned(s, d).filter("cluster_id is not null and speaker is not null").groupBy("session_id", "cluster_id").agg(F.min("speaker").alias("name"))
    return attribution.manual_sources(names.withColumn("source", F.when(F.length("name") % 2 == 0, F.lit("profile_match"))))


def q_fingerprint(s, d):
    return provenance.entity_fingerprint(aligned(s, d).withColumnRenamed("turn_id", "id"))


def q_prompt_hash(s, d):
    return table(s, d, "documents").select("doc_id", provenance.prompt_hash(F.col("text")).alias("prompt_hash"))


def q_roster(s, d):
    rows = table(s, d, "roster").filter("raw_description is not null").select(F.col("campaign_id").alias("source"), F.col("ord").alias("line_no"), F.concat("discord_username", F.lit(": "), "raw_description").alias("value")).distinct()
    return tables.parse_roster(rows).select("source", "username", "character_name", "role", F.array_join("nicknames", "|").alias("nicknames"), "is_dm", "ord")


def q_info(s, d):
    people = table(s, d, "roster").select("campaign_id", "ord", "discord_username").distinct()
    one = people.select(F.col("campaign_id").alias("source"), (F.col("ord") + 10).alias("line_no"), F.concat(F.col("ord") + 1, F.lit(". "), "discord_username").alias("value"))
    head = people.select("campaign_id").distinct().select(F.col("campaign_id").alias("source"), F.inline(F.array(F.struct(F.lit(0).alias("line_no"), F.concat(F.lit("Recording: "), "campaign_id").alias("value")), F.struct(F.lit(1).alias("line_no"), F.lit("Tracks:").alias("value")))))
    return tables.parse_info(head.unionByName(one))


def q_tracks(s, d):
    names = table(s, d, "roster").select(F.concat(F.col("ord") + 1, F.lit("-"), "discord_username", F.when(F.col("ord") % 2 == 0, ".flac").when(F.col("ord") % 3 == 0, ".FLAC").otherwise(".wav")).alias("name")).distinct()
    return tables.track_files(names)


def q_auto_assign(s, d):
    al = aligned(s, d).filter("cluster_id is not null")
    names = al.filter("seq % 4 > 0").groupBy("session_id", "cluster_id").agg(F.min("speaker").alias("name"), F.lit("manual").alias("source"))
    return attribution.auto_assign(names, al.filter("speaker is not null").groupBy("session_id", "cluster_id").agg(F.max("speaker").alias("name")))


def q_truncated(s, d):
    return table(s, d, "segments").groupBy("session_id").agg(F.bool_or("is_truncated").alias("truncated"))


def q_elisions(s, d):
    spoken = table(s, d, "segments").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(lore.WORD), F.lit(0))).alias("term"))
    words = table(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(lore.WORD), F.lit(0))).alias("term")).distinct()
    return lore.without_known_elisions(words, spoken)


def q_speaker_prompt(s, d):
    entities = lore.speaker_prompt_entities(table(s, d, "roster").dropDuplicates(["ord"]), table(s, d, "entities").dropDuplicates(["ord"]))
    return lore.biasing_prompt(entities, 60)


def q_reconstruction(s, d):
    rows = _md_turns(s, d).select("doc_id", "turn_no", "body")
    edited = F.when(F.col("turn_no") % 3 == 0, F.upper("body")).when(F.col("turn_no") % 3 == 1, F.concat("body", F.lit(" a b c d e f"))).otherwise(F.reverse("body"))
    return rows.select("doc_id", "turn_no", refine.reconstruction_reason("body", edited).alias("reason"))


def _glossary(s, d):
    notes = table(s, d, "documents").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("path"), "source", "text")
    spoken = table(s, d, "segments").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(lore.WORD), F.lit(0))).alias("term"))
    return notes, glossary.context_glossary(notes, spoken.distinct())


def q_glossary(s, d):
    return _glossary(s, d)[1].select("key", "term", "frequency", F.array_join("aliases", "|").alias("aliases"), F.size("sources").alias("n_sources"))


def q_glossary_names(s, d):
    notes = table(s, d, "documents").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("path"), "source", "text")
    names = glossary.note_names(glossary.note_parts(notes))
    return names.filter("phase = 1").groupBy("name", "alias").agg(F.count("*").alias("n_links"))


def q_glossary_hash(s, d):
    notes = table(s, d, "documents").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("path"), "text")
    return glossary.glossary_hash(notes, "fr", ["Zorvax"])


def q_glossary_reference(s, d):
    """References for the chunks of all transcripts."""
    _, entries = _glossary(s, d)
    chunks = refine.word_chunks(_md_turns(s, d)).groupBy(F.concat_ws("-", "doc_id", "chunk_no").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_start", "body"))), lambda x: x["body"]), " ").alias("text"))
    return glossary.reference_lists(cut(entries), chunks).select("chunk", F.size("terms").alias("n_terms"), F.md5("reference").alias("digest"))


def q_reconstruct(s, d):
    """Chunks of 60 words whose every third is answered with its words in capitals, others with words added or left out."""
    turns = _md_turns(s, d)
    chunks = cut(refine.word_chunks(turns, 60))
    text = F.when(F.col("chunk_no") % 3 == 0, F.upper("body")).when(F.col("chunk_no") % 3 == 1, F.concat(F.lit("un deux trois quatre cinq six "), "body")).otherwise(F.lit(""))
    answers = chunks.select("doc_id", "chunk_no", F.col("turn_no").alias("piece_no"), "speaker", "word_start", "word_end", text.alias("text"))
    return refine.reconstruct(chunks, answers, turns).select("doc_id", "chunk_no", "piece_no", "speaker", "start", "end", F.md5("text").alias("digest"), "reason")


def q_pipeline_run(s, d):
    names = aligned(s, d).filter("cluster_id is not null and speaker is not null and seq % 3 = 0").groupBy("session_id", "cluster_id").agg(F.min("speaker").alias("name"))
    return pipeline.run(segments(s, d), diar(s, d), names)


def q_multitrack(s, d):
    tracks = aligned(s, d).filter("speaker <> ''").select("session_id", F.concat(F.col("turn_id") % 7 + 1, F.lit("-"), "speaker", F.lit(".flac")).alias("track_id"), F.col("turn_id").alias("seq"), "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text"))
    people = table(s, d, "roster").select("ord", F.col("discord_username").alias("username"), "character_name", "is_dm").distinct()
    return pipeline.multitrack(tracks, people)


def q_track_labels(s, d):
    people = table(s, d, "roster").select("ord", F.col("discord_username").alias("username"), "character_name", "is_dm").distinct()
    spoken = aligned(s, d).filter("speaker <> ''").select("session_id", "turn_id", F.concat(F.col("turn_id") % 7 + 1, F.lit("-"), "speaker", F.lit(".flac")).alias("track_id"))
    return pipeline.track_labels(spoken, people)


def q_pipeline_recluster(s, d):
    rows = _embeddings(s, d).select(F.col("label").alias("session_id"), F.col("vec_id").alias("id"), "vector")
    return pipeline.recluster(rows, _profiles(s, d), 0.3, distance=0.9).select("session_id", "label", "name", F.round("cosine", 6).alias("cosine"))


def q_voice_assign(s, d):
    """Clusters of the embeddings are their labels; the even ones are named after the profile with their number."""
    rows = _embeddings(s, d).select(F.lit("all").alias("session_id"), F.col("label").alias("cluster_id"), "vector")
    people = _profiles(s, d).filter("speaker is not null").groupBy("speaker").agg(F.min_by("vector", "ord").alias("vector"), F.min("ord").alias("ord"))
    names = rows.select("session_id", "cluster_id").distinct().select("session_id", "cluster_id", F.when(F.col("cluster_id").cast("int") % 2 == 0, F.concat(F.lit("voice "), "cluster_id")).otherwise(F.concat(F.lit("SPEAKER_"), "cluster_id")).alias("name"), F.lit("manual").alias("source"))
    return pipeline.auto_assign(rows, names, people.select("speaker", "vector"))


def q_mapping_tables(s, d):
    """Mappings written as JSON and read again."""
    al = aligned(s, d).filter("speaker is not null and cluster_id is not null")
    stored = tables.save_mappings({
        "turn_names": al.filter("turn_id % 10 = 0").select("session_id", "turn_id", F.col("speaker").alias("name")),
        "cluster_names": al.groupBy("session_id", "cluster_id").agg(F.min("speaker").alias("name")).withColumn("source", F.when(F.length("name") % 2 == 0, F.lit("manual"))),
        "slice_names": al.filter("time_slice_id % 2 = 0").groupBy("session_id", "time_slice_id", "cluster_id").agg(F.max("speaker").alias("name")),
        "splits": al.groupBy("session_id").agg(F.lit(0).alias("seq"), F.min("cluster_id").alias("cluster_id"), F.max("start_ms").alias("at_ms"), F.lit("X").alias("new_cluster_id")),
    })
    read = tables.parse_mappings(cut(stored))
    row = lambda kind, df, key, name: df.select("session_id", F.lit(kind).alias("kind"), key.cast("string").alias("key"), name.cast("string").alias("name"))
    rows = row("turn", read["turn_names"], F.col("turn_id"), F.col("name")).unionByName(row("cluster", read["cluster_names"], F.col("cluster_id"), F.concat_ws("/", "name", "source")))
    return rows.unionByName(row("slice", read["slice_names"], F.concat_ws("/", "time_slice_id", "cluster_id"), F.col("name"))).unionByName(row("split", read["splits"], F.col("cluster_id"), F.col("at_ms")))


def q_track_hit(s, d):
    stored = table(s, d, "roster").select(F.col("discord_username").alias("track"), F.lit("large").alias("model_name"), F.lit("fr").alias("language"), (F.col("ord") * 1000).alias("size"), (F.col("ord") + 0.25).alias("mtime")).distinct()
    wanted = stored.withColumn("mtime", F.col("mtime") + F.when(F.col("size") % 3000 == 0, 0.5).otherwise(0.00005))
    return stored.alias("s").join(wanted.alias("e"), (F.col("s.track") == F.col("e.track")) & provenance.track_usable(), "left_semi").select("track", "size")


QUERIES = {
    "cluster_centroids": q_centroids, "profile_match_open": q_match_open, "cluster_classify_closed": q_classify_closed, "cluster_classify_allowed": q_classify_allowed, "profile_enrol": q_enrol,
    "profile_enrol_idempotent": q_enrol_again, "profile_enrol_all_again": q_enrol_all_again, "unsafe_sources": q_unsafe, "representative_runs": q_representative, "recluster_average_linkage": q_recluster, "entity_extract": q_entities,
    "entity_priority": q_priority, "ordered_distinct_names": q_names, "biasing_prompt": q_prompt, "control_token_strip": q_control, "line_ownership": q_ownership, "term_frequency": q_terms,
    "lexicon_anti": q_terms_unknown, "alias_unique": q_aliases, "glossary_pack": q_pack, "dice_normalize": q_dice, "markdown_turns": q_md_turns, "word_chunks": q_word_chunks, "turn_chunks": q_turn_chunks,
    "coverage_check": q_coverage, "turn_headers": q_headers, "refine_reason": q_reasons, "envelope_join": q_envelopes, "callout_strip": q_callouts, "callout_strip_all": q_callouts_all, "transcript_cache_hit": q_transcript_hit,
    "diarization_cache_hit": q_diarization_hit, "embedding_cache_hit": q_embedding_hit, "entity_fingerprint": q_fingerprint, "prompt_hash": q_prompt_hash, "roster_parse": q_roster, "info_parse": q_info, "track_discovery": q_tracks,
    "auto_assign": q_auto_assign, "truncated_sessions": q_truncated, "elision_filter": q_elisions, "speaker_prompt": q_speaker_prompt, "reconstruction_reason": q_reconstruction, "track_cache_hit": q_track_hit,
    "embeddings_reuse": q_embeddings_reuse, "provenance_hash": q_row_hash, "label_source_backfill": q_label_sources, "context_glossary": q_glossary, "glossary_names": q_glossary_names, "glossary_hash": q_glossary_hash, "glossary_reference": q_glossary_reference, "reconstruct": q_reconstruct, "pipeline_run": q_pipeline_run,
    "multitrack": q_multitrack, "track_labels": q_track_labels, "pipeline_recluster": q_pipeline_recluster, "voice_assign": q_voice_assign, "mapping_tables": q_mapping_tables,
}

EM = """em AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings WHERE embedding IS NOT NULL),
me AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM em GROUP BY ALL)"""
BEST = (
    EM
    + """, qv AS (SELECT label, list(x ORDER BY pos) AS v FROM me GROUP BY label),
pr AS (SELECT DISTINCT ord, speaker, list_transform(centroid, lambda x: CAST(x AS DOUBLE)) AS v FROM profiles WHERE len(centroid) = 64 AND len(list_filter(centroid, lambda x: x IS NULL)) = 0 AND len(list_filter(centroid, lambda x: x <> 0)) > 0),
bs AS (SELECT label AS query, CAST(ord AS BIGINT) AS ord, speaker, list_cosine_similarity(qv.v, pr.v) AS c FROM qv CROSS JOIN pr {0}),
bb AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, ord) AS n FROM bs) SELECT query, ord, round(c, 6) AS cosine FROM bb WHERE n = 1 {1}"""
)
HALF = """WITH em AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings WHERE embedding IS NOT NULL),
o AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM em WHERE vec_id % 2 = 0 GROUP BY ALL), w AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM em WHERE vec_id % 2 = 1 GROUP BY ALL),
ou AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS u FROM o)"""
LINES = r"""l0 AS (SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '<\|[^<>|]*\|>', '', 'g'), '<\|[^<>|]*\|>', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, source, regexp_replace(regexp_replace(t, '<\||\|>|<>', '', 'g'), '(?s)\A---\n.*?\n---[ \t]*(\n|\z)|```.*?```', chr(10), 'g') AS t FROM l0),
l2 AS (SELECT doc_id, source, regexp_replace(t, '!\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)|`[^`\n]*`|https?://\S+|<[^<>\n]*>', ' ', 'g') AS t FROM l1),
l3 AS (SELECT doc_id, source, regexp_replace(regexp_replace(t, '\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]', '\1', 'g'), '\[([^\[\]]*)\]\([^)]*\)', '\1', 'g') AS t FROM l2),
l4 AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM l3),
ln AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(line, '^\s*(?:[#>]+|[-*+]\s|\d+\.\s)\s*', ''), '[\s\x{0b}\x{85}\x{1c}-\x{1f}\p{Z}]+', ' ', 'g')) AS line FROM l4),
vl AS (SELECT * FROM ln WHERE line <> ''), ow AS (SELECT line, min(doc_id) AS owner FROM vl GROUP BY line), ol AS (SELECT vl.* FROM vl JOIN ow ON vl.line = ow.line AND doc_id = owner)"""
WORD = r"\p{L}[\p{L}\p{N}]*(?:[''’\-][\p{L}\p{N}]+)*"
TERMS = (
    LINES
    + f""", tf AS (SELECT term, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(line), '{WORD}')) AS term FROM ol) WHERE length(term) >= 2 GROUP BY term),
ts AS (SELECT term, count(DISTINCT source) AS n_sources FROM (SELECT source, unnest(regexp_extract_all(lower(line), '{WORD}')) AS term FROM vl) WHERE length(term) >= 2 GROUP BY term)"""
)
#: Turns of a transcript by splitting at the headings (RE2 has no look-ahead).
MD = r"""m0 AS (SELECT doc_id, unnest(string_split(chr(10) || text, chr(10) || '### [')) AS b, unnest(range(len(string_split(chr(10) || text, chr(10) || '### [')))) AS k FROM documents WHERE kind = 'transcript' AND text IS NOT NULL),
m1 AS (SELECT doc_id, k, regexp_extract(b, '^(\d+:\d+:\d+) - (\d+:\d+:\d+)\] ([^\n]*)\n', 1) AS "start", regexp_extract(b, '^(\d+:\d+:\d+) - (\d+:\d+:\d+)\] ([^\n]*)\n', 2) AS "end", trim(regexp_extract(b, '^(\d+:\d+:\d+) - (\d+:\d+:\d+)\] ([^\n]*)\n', 3)) AS speaker,
  trim(regexp_replace(regexp_replace(b, '^[^\n]*\n', ''), '[\s\x{0b}\x{85}\x{1c}-\x{1f}\p{Z}]+', ' ', 'g')) AS body FROM m0 WHERE k > 0 AND regexp_matches(b, '^(\d+:\d+:\d+) - (\d+:\d+:\d+)\] ([^\n]*)\n')),
m2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS turn_no, len(string_split(body, ' ')) AS n, bool_and(body <> '') OVER (PARTITION BY doc_id) AS ok FROM m1),
md AS (SELECT doc_id, CAST(turn_no AS INTEGER) AS turn_no, speaker, "start", "end", CAST(sum(n) OVER w - n AS INTEGER) AS word_start, CAST(sum(n) OVER w AS INTEGER) AS word_end FROM m2 WHERE ok WINDOW w AS (PARTITION BY doc_id ORDER BY turn_no)),
wc AS (SELECT doc_id, turn_no, c AS chunk_no, greatest(word_start, c * 20) AS word_start, least(word_end, c * 20 + 20) AS word_end FROM (SELECT *, unnest(range(word_start // 20, (word_end - 1) // 20 + 1)) AS c FROM md))"""
ST = (
    DI
    + """, st AS (SELECT session_id AS media_hash, CASE count(*) % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'nemotron' ELSE 'ecapa' END AS engine, CASE WHEN count(*) % 2 = 0 THEN 'ecapa' END AS resolved_engine,
  CASE WHEN max(end_ms) % 2 = 0 THEN 'cuda' ELSE 'cpu' END AS device, CASE WHEN max(end_ms) % 3 > 0 THEN 't' END AS transcript_hash FROM di GROUP BY session_id)"""
)

TRACKS = """ro AS (SELECT DISTINCT ord, discord_username AS u, coalesce(nullif(character_name, ''), CASE WHEN is_dm THEN 'MJ' END, discord_username) || ' (' || discord_username || ')' AS label FROM roster WHERE discord_username IS NOT NULL),
ex AS (SELECT u, arg_min(label, ord) AS label FROM ro GROUP BY u), fo AS (SELECT lower(u) AS u, arg_min(label, ord) AS label FROM ro GROUP BY lower(u)),
tl AS (SELECT session_id, turn_id AS seq, start_ms, end_ms, text, (turn_id % 7 + 1) || '-' || speaker || '.flac' AS track_id, coalesce(ex.label, fo.label, speaker) AS label FROM al LEFT JOIN ex ON ex.u = speaker LEFT JOIN fo ON fo.u = lower(speaker) WHERE speaker <> '')"""

ORACLES = {
    "cluster_centroids": f"WITH {EM} SELECT label, n, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM me",
    "profile_match_open": "WITH " + BEST.format("", "AND c >= 0.3"),
    "cluster_classify_closed": "WITH " + BEST.format("", ""),
    "cluster_classify_allowed": "WITH " + BEST.format("WHERE speaker IN (SELECT character_name FROM roster)", ""),
    "profile_enrol": HALF + ", mm AS (SELECT ou.label, ou.pos, ou.n + w.n AS n, (ou.n * u + w.n * w.x) / (ou.n + w.n) AS x FROM ou JOIN w ON w.label = ou.label AND w.pos = ou.pos) SELECT label AS speaker, n AS sample_count, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM mm",
    "profile_enrol_idempotent": HALF + " SELECT label AS speaker, n AS sample_count, CAST(pos AS INTEGER) AS pos, round(u, 6) AS x FROM ou",
    "profile_enrol_all_again": f"WITH {EM} SELECT label AS speaker, n AS sample_count, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM me",
    "unsafe_sources": f"WITH {AL} SELECT session_id, coalesce(source_turn_id, turn_id) AS source_turn_id FROM al GROUP BY ALL HAVING bool_or(uncertain) OR count(DISTINCT speaker) > 1 OR count(DISTINCT cluster_id) > 1",
    "representative_runs": f"WITH {AL} SELECT session_id, coalesce(source_turn_id, turn_id) AS source_turn_id, arg_min(turn_id, (turn_id <> coalesce(source_turn_id, turn_id), start_ms, turn_id)) AS turn_id, arg_min(start_ms, (turn_id <> coalesce(source_turn_id, turn_id), start_ms, turn_id)) AS start_ms FROM al GROUP BY session_id, coalesce(source_turn_id, turn_id)",
    "entity_extract": r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1), lambda x: {'kind': 'wikilink', 'name': CASE WHEN contains(x, '|') THEN string_split(x, '|')[-1] ELSE string_split(x, '#')[1] END})
  || list_transform(regexp_extract_all(regexp_extract(text, '(?m)^aliases:[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|$))+)', 1), '(?m)^[ \t]*-[ \t]+(.*)$', 1), lambda x: {'kind': 'alias', 'name': x})
  || list_transform(regexp_extract_all(text, '(?m)^##[ \t]+([^#\n]+)', 1), lambda x: {'kind': 'heading', 'name': x}) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS e, CAST(unnest(range(len(l))) AS INTEGER) AS pos FROM d), c AS (SELECT doc_id, e.kind AS kind, pos, trim(regexp_replace(regexp_replace(regexp_replace(e.name, '<\|[^<>|]*\|>', '', 'g'), '<\||\|>|<>', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS name FROM u)
SELECT * FROM c WHERE name <> '' AND NOT regexp_matches(lower(name), '\.(png|jpg|jpeg|webp|gif|svg|pdf|mp3|wav|flac)$')""",
    "entity_priority": "SELECT DISTINCT ord, CASE lower(kind) WHEN 'speaker' THEN 0 WHEN 'character' THEN 0 WHEN 'nickname' THEN 0 WHEN 'custom' THEN 1 WHEN 'wikilink' THEN 2 WHEN 'alias' THEN 3 WHEN 'heading' THEN 4 ELSE 5 END AS priority FROM entities",
    "ordered_distinct_names": "WITH u AS (SELECT campaign_id, character_name AS name, 0 AS rank, CAST(ord AS BIGINT) AS ord FROM roster UNION ALL SELECT campaign_id, name, 1, CAST(ord AS BIGINT) FROM entities), n AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, name ORDER BY rank, ord) AS k FROM u WHERE name IS NOT NULL) SELECT campaign_id, name, rank, ord FROM n WHERE k = 1",
    "biasing_prompt": r"""WITH c AS (SELECT DISTINCT campaign_id, ord, trim(regexp_replace(name, '[\s\p{Z}]+', ' ', 'g')) AS name, CASE lower(kind) WHEN 'speaker' THEN 0 WHEN 'character' THEN 0 WHEN 'nickname' THEN 0 WHEN 'custom' THEN 1 WHEN 'wikilink' THEN 2 WHEN 'alias' THEN 3 WHEN 'heading' THEN 4 ELSE 5 END AS p FROM entities WHERE name IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, lower(name) ORDER BY p, ord, name) AS k FROM c WHERE name <> ''), s AS (SELECT *, sum(len(string_split(name, ' '))) OVER (PARTITION BY campaign_id ORDER BY p, ord, name) AS total FROM d WHERE k = 1)
SELECT campaign_id, coalesce(string_agg(name, ', ' ORDER BY p, ord, name) FILTER (total <= 180), '') AS prompt FROM s GROUP BY campaign_id""",
    "control_token_strip": "WITH a AS (SELECT doc_id, " + "regexp_replace(" * 8 + "text" + r", '<\|[^<>|]*\|>', '', 'g')" * 8 + r" AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(regexp_replace(t, '<\||\|>|<>', '', 'g')) AS digest FROM a",
    "line_ownership": f"WITH {LINES} SELECT doc_id, count(*) AS n_lines FROM ol GROUP BY doc_id",
    "term_frequency": f"WITH {TERMS} SELECT term, frequency, n_sources FROM tf JOIN ts USING (term)",
    "lexicon_anti": f"WITH {TERMS} SELECT term, frequency, n_sources FROM tf JOIN ts USING (term) WHERE term NOT IN (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) FROM segments WHERE text IS NOT NULL)",
    "alias_unique": "WITH a AS (SELECT unnest(nicknames) AS alias, character_name AS name FROM roster) SELECT alias, min(name) AS name FROM a WHERE alias NOT IN (SELECT name FROM a WHERE name IS NOT NULL) GROUP BY alias HAVING count(DISTINCT name) = 1",
    "markdown_turns": f"WITH {MD} SELECT doc_id, turn_no, speaker, word_start, word_end FROM md",
    "word_chunks": f"WITH {MD} SELECT doc_id, chunk_no, turn_no, word_start, word_end FROM wc",
    "turn_chunks": f"WITH {MD} SELECT doc_id, turn_no // 5 AS chunk_no, count(*) AS n_turns FROM md GROUP BY ALL",
    "coverage_check": f"WITH {MD} SELECT DISTINCT doc_id, true AS covered FROM wc",
    "turn_headers": r"WITH h AS (SELECT doc_id, regexp_extract_all(text, '(?m)^### \[.*$') AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(h) AS INTEGER) AS n_headers, coalesce(array_to_string(list_transform(h, lambda x: trim(replace(x, chr(13), ''))), '|'), '') AS headers FROM h",
    "refine_reason": r"WITH t AS (SELECT doc_id, text, regexp_matches(text, '(?m)^### \[') AS hd FROM documents WHERE kind = 'transcript' AND text IS NOT NULL), n AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> '')) AS n FROM t) SELECT doc_id, CASE WHEN doc_id % 4 = 1 AND trim(text) <> '' THEN 'empty result' WHEN doc_id % 4 = 2 AND hd THEN 'headings differ' WHEN doc_id % 4 = 3 AND 200 > (CASE WHEN n = 0 THEN 0 ELSE greatest(5, n * 15 // 100) END) THEN 'word count differs' END AS reason FROM n",
    "envelope_join": f"""WITH {MD}, pc AS (SELECT doc_id, chunk_no AS piece_no, min(word_start) AS ws, max(word_end) AS we FROM wc GROUP BY ALL) SELECT pc.doc_id, piece_no, arg_min("start", list_reduce(list_transform(string_split("start", ':'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 60 + b)) AS "start", arg_max("end", list_reduce(list_transform(string_split("end", ':'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 60 + b)) AS "end" FROM pc JOIN md ON md.doc_id = pc.doc_id AND ws < word_end AND we > word_start GROUP BY ALL""",
    "callout_strip": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(coalesce(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^[\s\x{0b}]*\[!')), chr(10)), '')) AS digest FROM l""",
    "callout_strip_all": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(coalesce(array_to_string(list_transform(list_filter(l, lambda x: NOT regexp_matches(x, '^[\s\x{0b}]*>[\s\x{0b}]*\[!')), lambda x: regexp_replace(x, '^[\s\x{0b}]*>[\s\x{0b}]?', '')), chr(10)), '')) AS digest,
  md5(coalesce(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^[\s\x{0b}]*\[!')), chr(10)), '')) AS wrapped_digest FROM l""",
    "transcript_cache_hit": f"WITH {ST} SELECT media_hash, engine FROM st WHERE engine = 'ecapa'",
    "diarization_cache_hit": f"WITH {ST} SELECT media_hash, engine FROM st WHERE (engine = 'ecapa' OR resolved_engine = 'ecapa') AND device = 'cuda' AND transcript_hash = 't'",
    "embedding_cache_hit": f"WITH {DI} SELECT session_id AS media_hash, count(*) AS count FROM di GROUP BY session_id HAVING max(id) % 2 = 0",
    "entity_fingerprint": f"WITH {AL} SELECT session_id, sha256(string_agg(turn_id || ':' || start_ms || ':' || end_ms || ':' || coalesce(text, ''), ';' ORDER BY turn_id)) AS fingerprint FROM al GROUP BY session_id",
    "prompt_hash": "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'no_prompt' ELSE left(sha256(text), 16) END AS prompt_hash FROM documents",
    "roster_parse": "SELECT DISTINCT campaign_id AS source, discord_username AS username, character_name, role, array_to_string(nicknames, '|') AS nicknames, is_dm, ord FROM roster WHERE raw_description IS NOT NULL",
    "info_parse": "WITH r AS (SELECT DISTINCT campaign_id, ord, discord_username FROM roster) SELECT campaign_id AS source, ord + 10 AS line_no, 'track' AS section, CAST(ord + 1 AS VARCHAR) AS key, discord_username AS value FROM r UNION ALL SELECT DISTINCT campaign_id, 0, 'header', 'recording', campaign_id FROM r",
    "track_discovery": "WITH n AS (SELECT DISTINCT ord, discord_username AS username, (ord + 1) || '-' || discord_username AS stem FROM roster) SELECT stem || CASE WHEN ord % 2 = 0 THEN '.flac' ELSE '.FLAC' END AS name, CAST(ord + 1 AS BIGINT) AS track_no, username FROM n WHERE ord % 2 = 0 OR ord % 3 = 0",
    "auto_assign": f"WITH {AL}, c AS (SELECT * FROM al WHERE cluster_id IS NOT NULL), n AS (SELECT session_id, cluster_id, min(speaker) AS name FROM c WHERE seq % 4 > 0 GROUP BY ALL), m AS (SELECT session_id, cluster_id, max(speaker) AS mname FROM c WHERE speaker IS NOT NULL GROUP BY ALL), j AS (SELECT *, coalesce(starts_with(name, 'SPEAKER_'), true) AND mname IS NOT NULL AS t FROM (SELECT session_id, cluster_id, name, 'manual' AS source FROM n) FULL JOIN m USING (session_id, cluster_id)) SELECT session_id, cluster_id, CASE WHEN t THEN mname ELSE name END AS name, CASE WHEN t THEN 'profile_match' ELSE source END AS source FROM j",
    "truncated_sessions": "SELECT session_id, bool_or(is_truncated) AS truncated FROM segments GROUP BY session_id",
    "elision_filter": f"""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM segments WHERE text IS NOT NULL), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents WHERE text IS NOT NULL),
p AS (SELECT term, string_split(replace(term, '’', chr(39)), chr(39)) AS p FROM w) SELECT term FROM p WHERE NOT coalesce(len(p) = 2 AND p[1] IN ('c','d','j','l','m','n','s','t','qu','jusqu','lorsqu','puisqu') AND p[2] IN (SELECT term FROM s), false)""",
    "embeddings_reuse": f"""WITH {DI}, {SE}, c AS (SELECT session_id AS media_hash, 'turn' AS entity_kind, count(*) AS n FROM di GROUP BY session_id UNION ALL SELECT session_id, 'segment', count(*) FROM se GROUP BY session_id)
SELECT media_hash, entity_kind, n AS count FROM c WHERE n % 2 = 0 AND n % 3 > 0 AND n % 5 > 0""",
    "provenance_hash": f"""WITH {AL} SELECT session_id, turn_id, start_ms, sha256('{{"session_id":"' || session_id || '","start_ms":' || start_ms || ',"turn_id":' || turn_id || '}}') AS hash FROM al""",
    "label_source_backfill": f"WITH {AL}, n AS (SELECT session_id, cluster_id, min(speaker) AS name FROM al WHERE cluster_id IS NOT NULL AND speaker IS NOT NULL GROUP BY ALL) SELECT *, CASE WHEN length(name) % 2 = 0 THEN 'profile_match' WHEN NOT starts_with(name, 'SPEAKER_') THEN 'manual' END AS source FROM n",
    "glossary_pack": """WITH RECURSIVE k AS (SELECT campaign_id, name AS term, -count(DISTINCT ord) AS rank FROM entities WHERE name IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY rank, term) AS i FROM k),
f AS (SELECT DISTINCT campaign_id, CAST(0 AS BIGINT) AS i, CAST(2 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS picked FROM r
  UNION ALL SELECT f.campaign_id, r.i, CASE WHEN f.n + length(term) + 2 + least(len(picked), 1) <= 1500 THEN f.n + length(term) + 2 + least(len(picked), 1) ELSE f.n END,
    CASE WHEN f.n + length(term) + 2 + least(len(picked), 1) <= 1500 THEN list_append(picked, term) ELSE picked END FROM f JOIN r ON r.campaign_id IS NOT DISTINCT FROM f.campaign_id AND r.i = f.i + 1)
SELECT campaign_id, array_to_string(arg_max(picked, i), '|') AS terms, arg_max(n, i) AS n_chars FROM f GROUP BY campaign_id""",
    "speaker_prompt": r"""WITH e AS (SELECT DISTINCT campaign_id, ord, character_name AS name, 0 AS p FROM roster UNION SELECT campaign_id, ord, unnest(nicknames), 0 FROM roster
  UNION SELECT campaign_id, ord + 1000000, name, CASE lower(kind) WHEN 'speaker' THEN 0 WHEN 'character' THEN 0 WHEN 'nickname' THEN 0 WHEN 'custom' THEN 1 WHEN 'wikilink' THEN 2 WHEN 'alias' THEN 3 WHEN 'heading' THEN 4 ELSE 5 END FROM entities x
    WHERE NOT EXISTS (SELECT 1 FROM roster u WHERE u.campaign_id = x.campaign_id AND u.discord_username = x.name)),
c AS (SELECT campaign_id, ord, trim(regexp_replace(name, '[\s\p{Z}]+', ' ', 'g')) AS name, p FROM e WHERE name IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, lower(name) ORDER BY p, ord, name) AS k FROM c WHERE name <> ''), s AS (SELECT *, sum(len(string_split(name, ' '))) OVER (PARTITION BY campaign_id ORDER BY p, ord, name) AS total FROM d WHERE k = 1)
SELECT campaign_id, coalesce(string_agg(name, ', ' ORDER BY p, ord, name) FILTER (total <= 60), '') AS prompt FROM s GROUP BY campaign_id""",
    "glossary_names": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(replace(text, chr(13) || chr(10), chr(10))), '<\|[^<>|]*\|>', '', 'g'), '!\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)', '', 'g') AS t FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT unnest(regexp_extract_all(regexp_replace(t, '(?ms)^---[ \t]*\n[A-Za-z_]+:.*?^---[ \t]*$', '', 'g'), '\[\[([^\]\n]+)\]\]', 1)) AS x FROM t),
n AS (SELECT trim(regexp_replace(split_part(split_part(x, '|', 1), '#', 1), '[\s\p{Z}]+', ' ', 'g')) AS name, CASE WHEN contains(x, '|') THEN trim(regexp_replace(substring(x, instr(x, '|') + 1), '[\s\p{Z}]+', ' ', 'g')) END AS alias FROM l)
SELECT name, CASE WHEN regexp_matches(alias, '\p{L}') THEN alias END AS alias, count(*) AS n_links FROM n WHERE regexp_matches(name, '\p{L}') GROUP BY ALL""",
    "pipeline_run": f"WITH {MATCH}, {RUNS}, {AL}, {{names}}, sp AS (SELECT ru.session_id, CAST(run_id AS INTEGER) AS turn_id, start_ms, end_ms, coalesce(cn.name, ru.cluster_id) AS speaker, text, uncertain FROM ru LEFT JOIN cn ON cn.session_id = ru.session_id AND cn.cluster_id = ru.cluster_id), {debounce_sql('sp')} SELECT * FROM de".replace("{names}", "cn AS (SELECT session_id, cluster_id, min(speaker) AS name FROM al WHERE cluster_id IS NOT NULL AND speaker IS NOT NULL AND seq % 3 = 0 GROUP BY ALL)"),
    "multitrack": f"WITH {AL}, {{tr}}, mt AS (SELECT tl.session_id, row_number() OVER (PARTITION BY tl.session_id ORDER BY start_ms, track_id, seq) - 1 AS turn_id, start_ms, end_ms, label AS speaker, coalesce(text, '') AS text, false AS uncertain FROM tl), {debounce_sql('mt')} SELECT * FROM de".replace("{tr}", "{TRACKS}").replace("{TRACKS}", TRACKS),
    "track_labels": f"WITH {AL}, {TRACKS} SELECT session_id, seq AS turn_id, track_id, label AS speaker FROM tl",
    "mapping_tables": f"""WITH {AL}, x AS (SELECT * FROM al WHERE speaker IS NOT NULL AND cluster_id IS NOT NULL) SELECT session_id, 'turn' AS kind, CAST(turn_id AS VARCHAR) AS key, speaker AS name FROM x WHERE turn_id % 10 = 0
UNION ALL SELECT session_id, 'cluster', cluster_id, CASE WHEN length(min(speaker)) % 2 = 0 THEN min(speaker) || '/manual' ELSE min(speaker) END FROM x GROUP BY session_id, cluster_id
UNION ALL SELECT session_id, 'slice', time_slice_id || '/' || cluster_id, max(speaker) FROM x WHERE time_slice_id % 2 = 0 GROUP BY session_id, time_slice_id, cluster_id
UNION ALL SELECT session_id, 'split', min(cluster_id), CAST(max(start_ms) AS VARCHAR) FROM x GROUP BY session_id""",
    "track_cache_hit": "SELECT DISTINCT discord_username AS track, ord * 1000 AS size FROM roster WHERE ord % 3 <> 0",
}
