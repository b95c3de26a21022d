"""Readers of rosters, stored mappings and stored rows, and the labels of tracks."""

from __future__ import annotations

from voxframe.plans import pipeline
from voxframe.sources import tables

ROSTER = """# Speakers
// Another comment

* tessaro: Le MJ, Maître du Jeu
* merrow1: Merrow Ashdale, barde humain, surnoms: (Mimi)
- player3: Thorin Oakenshield, nain guerrier, surnoms: (Thor, Petit), roux
* player4: MJ
* player5: Simple Character
* gm_user: DM, Game Master
* player_a: Alice, surnoms: Aly, Ali
no_bullet: Bob
long: A, b, c, d
twice: First
twice: Second, surnom: X
invalid line without colon
"""


def test_roster(spark):
    lines = spark.createDataFrame([("s", i, v) for i, v in enumerate(ROSTER.split("\n"))], "source string, line_no int, value string")
    got = {r.username: (r.character_name, r.role, list(r.nicknames), r.is_dm) for r in tables.parse_roster(lines).collect()}
    assert got == {
        "tessaro": ("MJ", "Maître du Jeu", [], True), "merrow1": ("Merrow Ashdale", "barde humain", ["Mimi"], False), "player3": ("Thorin Oakenshield", "nain guerrier, roux", ["Thor", "Petit"], False),
        "player4": ("MJ", None, [], True), "player5": ("Simple Character", None, [], False), "gm_user": ("MJ", "Game Master", [], True), "player_a": ("Alice", None, ["Aly", "Ali"], False), "no_bullet": ("Bob", None, [], False),
        "long": ("A", "b, c, d", [], False), "twice": ("Second", None, ["X"], False),
    }


def test_mappings(spark):
    now = '{"cluster_defaults": {"C0": "Brakk", "C1": "SPEAKER_01"}, "turn_overrides": {"4": "Dorsa", "x": "no"}, "slice_overrides": {"1": {"C0": "Merrow"}}, "label_sources": {"C0": "manual"}, "splits": [{"cluster_id": "C0", "at": 42.5, "new_cluster_id": "C9"}]}'
    files = spark.createDataFrame([("now", now), ("old", '{"C0": "Brakk", "7": "Dorsa"}'), ("bad", '{"C0": '), ("list", "[1]"), ("none", None), ("empty", "{}")], "session_id string, value string")
    got = {k: sorted(map(tuple, df.collect())) for k, df in tables.parse_mappings(files).items()}
    assert got["turn_names"] == [("now", 4, "Dorsa"), ("old", 7, "Dorsa")]
    assert got["cluster_names"] == [("now", "C0", "Brakk", "manual"), ("now", "C1", "SPEAKER_01", None), ("old", "C0", "Brakk", None)]
    assert got["slice_names"] == [("now", 1, "C0", "Merrow")] and got["splits"] == [("now", 0, "C0", 42500, "C9")]
    assert {s for s, _ in got["corrupt"]} == {"bad", "list"}


def test_stored_rows(spark):
    files = spark.createDataFrame([("a", '{"turns": [{"id": 1, "start": 0.5}, {"id": 2, "start": 1.5}], "version": 1}'), ("b", ' [{"id": 3, "start": 2.0}]'), ("c", "nothing"), ("d", None)], "key string, value string")
    assert sorted(map(tuple, tables.parse_stored_rows(files, "turns", "id int, start double").collect())) == [("a", 0, 1, 0.5), ("a", 1, 2, 1.5), ("b", 0, 3, 2.0)]


def test_track_provenance_and_sources(spark, tmp_path):
    (tmp_path / "1-alice.flac").write_bytes(b"abc")
    (tmp_path / "good.md").write_text("é", encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"\xffx")
    row = tables.track_provenance(tables.file_hashes(spark, str(tmp_path)).filter("path like '%flac'"), "large", "fp16", "no_prompt").first()
    assert (row.track, row.model_name, row.language, row.source_file_size, row.schema_version) == ("1-alice.flac", "large", "fr", 3, 1) and row.source_file_mtime > 0
    assert sorted((r.text, len(r.hash)) for r in tables.glossary_sources(spark, str(tmp_path)).collect() if r.text) == [("é", 64)] and tables.glossary_sources(spark, str(tmp_path)).count() == 2


def test_track_labels(spark):
    roster = spark.createDataFrame([(0, "Alice", "Alice A", False), (1, "alice", "Other", False), (2, "gm", None, True), (3, "bob", "", False)], "ord int, username string, character_name string, is_dm boolean")
    tracks = spark.createDataFrame([(t,) for t in ["1-alice.flac", "1-ALICE", "2-gm", "3-bob.FLAC", "stranger", "4-user.name.flac"]], "track_id string")
    got = {r.track_id: r.speaker for r in pipeline.track_labels(tracks, roster).collect()}
    assert got == {"1-alice.flac": "Other (alice)", "1-ALICE": "Alice A (Alice)", "2-gm": "MJ (gm)", "3-bob.FLAC": "bob (bob)", "stranger": "stranger", "4-user.name.flac": "user.name"}


def test_voices_of_named_clusters(spark):
    rows = spark.createDataFrame([("s", "A", [1.0, 0.0]), ("s", "B", [0.9, 0.2]), ("s", "C", [0.0, 1.0]), ("s", "D", [0.1, 0.9])], "session_id string, cluster_id string, vector array<double>")
    names = spark.createDataFrame([("s", "A", "Brakk", "manual"), ("s", "B", "SPEAKER_01", None)], "session_id string, cluster_id string, name string, source string")
    profiles = spark.createDataFrame([("Dorsa", [0.0, 1.0])], "speaker string, vector array<double>")
    got = {r.cluster_id: (r.name, r.source) for r in pipeline.auto_assign(rows, names, profiles).collect()}
    assert got == {"A": ("Brakk", "manual"), "B": ("Brakk", "profile_match"), "C": ("Dorsa", "profile_match"), "D": ("Dorsa", "profile_match")}
