from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm.names import _person_keys, _probe_keys, common_length, likeness, link_names, name_score
from voxframe.llm.transcripts import clean_turns, name_before, cluster_persons, optimal_assignment, resolve_labels, spoken_words, without_dash, without_time_marks

PEOPLE = [("c", 0, "gotol.11", "Balquidra Prastone", ["Thiwen"], False), ("c", 1, "tolfen37", "Riquilo Phimont", [], False), ("c", 2, "boss_1", "MJ", None, True), ("c", 2, "boss_1", "MJ", None, True), ("d", 3, "other", "Arphi Steval", ["Halar"], False), ("c", 4, None, None, None, None)]
SCHEMA = "campaign string, person long, username string, character string, nicknames array<string>, is_dm boolean"

SAME = ["Balquidra Prastone", "PRASTONE, balquidra", "B. Prastone", "Balquidra P.", "Balquidr Prast.", "BalquidraPrastone", "Balquidra-Prastone", "Dame Prastone", "Sire Balquidra Prastone", "Balquidra « Thiwen » Prastone", "Thiwen Prastone", "Thiwen", "Balqiudra Prastoone", "Balkidra", "balquidra prastone#Histoire", "gotol.11", "GOTOL 11"]
OTHER = ["Balquidra Zevirimval", "Marce Prastone", "Guilde de Prastone", "Port-Balquidra", "B. P.", "B.", "", "?", "MJ", "gotol.12", "Linrimar"]


@pytest.mark.parametrize("name", SAME)
def test_variants(name):
    assert name_score(name, "gotol.11", "Balquidra Prastone", ("Thiwen",), False) > 0


@pytest.mark.parametrize("name", OTHER)
def test_other_names(name):
    assert name_score(name, "gotol.11", "Balquidra Prastone", ("Thiwen",), False) == 0


def test_links(spark):
    people = spark.createDataFrame(PEOPLE, SCHEMA)
    typed = [("c", n) for n in (*SAME, *OTHER, "Rikilo Fimont", "le MJ", "Arphi Steval")] + [("d", "Arfi Stevall"), (None, "Thiwen"), ("c", None), ("x", "Thiwen")]
    got = {(r.campaign, r.name): r.person for r in link_names(spark.createDataFrame([(*t, 5) for t in typed], "campaign string, name string, score int"), people).collect()}
    assert got == {("c", n): 0 for n in SAME} | {("c", "MJ"): 2, ("c", "le MJ"): 2, ("c", "Rikilo Fimont"): 1, ("d", "Arfi Stevall"): 3}
    assert link_names(spark.createDataFrame([], "campaign string, name string"), people).count() == 0


def test_blocking_loses_nothing(spark, small):
    people = spark.read.parquet(f"{small}/roster.parquet").select(F.col("campaign_id").alias("campaign"), F.col("ord").cast("long").alias("person"), F.col("discord_username").alias("username"), F.col("character_name").alias("character"), "nicknames", "is_dm")
    typed = spark.read.parquet(f"{small}/entities.parquet").select(F.col("campaign_id").alias("campaign"), "name").distinct()
    want, roster = {}, {r.person: r for r in people.collect()}
    for t in typed.filter("name is not null").collect():
        scores = sorted(((name_score(t.name, p.username, p.character, tuple(p.nicknames), p.is_dm), k) for k, p in roster.items() if p.campaign == t.campaign), reverse=True)
        if scores and scores[0][0] and (len(scores) == 1 or scores[1][0] < scores[0][0]):
            want[t.campaign, t.name] = scores[0][1]
    assert {(r.campaign, r.name): r.person for r in link_names(typed, people).collect()} == want


def test_typos_inside_short_tokens(spark):
    people = spark.createDataFrame([("c", 0, "u0", "Gotar Prastone", [], False), ("c", 1, "u1", "Mirvi Phimont", [], False), ("c", 2, "u2", "Alba Kor", ["Harel"], False)], SCHEMA)
    typed = spark.createDataFrame([("c", n) for n in ("Goatr", "Mrivi", "Hrael", "Kor", "KrAolba", "Gotax Zolt")], "campaign string, name string")
    got = {r.name: r.person for r in link_names(typed, people).collect()}
    assert got == {"Goatr": 0, "Mrivi": 1, "Hrael": 2, "Kor": 2}


def test_keys_are_shared_by_all_that_the_score_accepts():
    rng, shared = np.random.default_rng(1), 0
    for _ in range(4000):
        a = list(rng.choice(list("abcqufphk"), int(rng.integers(3, 45))))
        b = list(a)
        for _ in range(int(rng.integers(0, 3))):
            i = int(rng.integers(0, len(b)))
            b[i : i + 1] = [[], [str(rng.choice(list("abk")))], [b[i], "z"], ["z", b[i]]][int(rng.integers(0, 4))]
        a, b = "".join(a), "".join(b)
        if b and likeness(a, b):
            shared += 1
            assert set(_probe_keys("~" + a)) & set(_person_keys("", b, (), False))
    assert shared > 2000


def test_common_length():
    assert common_length("kellande", "kelalnde") == 7 and common_length("", "a") == 0


TEXTS = [
    ("[00:18:48,791] le moine", "le moine"), ("00:08:36 - parfait, oui", "parfait, oui"), ("00:03:57.801 --> (rire étouffé)", ""), ("07:06 | Le chef ♪ musique ♪", "Le chef"), ("hum [silence] Euuuh…", ""),
    ("On reprend vers 20h30 (si je me souviens bien)", "On reprend vers 20h30 (si je me souviens bien)"), ("la [00:13:54,785]porte <|18.47|> euh-euh", "la porte"), ("tu as eu [ou plutôt la deuxième] *soupir*", "tu as eu [ou plutôt la deuxième]"),
    ("((inaudible) oui", "oui"), ("on part à 20:30 ce soir", "on part à 20:30 ce soir"), ("[45m05s] oui {musique}", "oui"), (None, ""), ("", ""),
]


def test_spoken_words(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i int, t string")
    text = without_dash(without_time_marks(F.coalesce("t", F.lit(""))))
    got = {r.i: r.w for r in df.select("i", F.array_join(spoken_words(text), " ").alias("w")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [w for _, w in TEXTS]
    names = ["**Halstemar Quiroc (gago46)** : Le", "- Tolsénze : Une", "KELSEN: le", "3-duvo75: le", "le vieux"]
    keys = spark.createDataFrame([(n,) for n in names], "t string").select(name_before(F.col("t")).alias("k")).collect()
    assert [r.k for r in keys] == ["halstemarquirocgago46", "tolsenze", "kelsen", "duvo75", None]


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 5), (5, 3), (2, 6)):
        gain = rng.integers(0, 9, (n, m)).astype(float)
        found = optimal_assignment(gain)
        used = found[found >= 0]
        assert len(set(used)) == len(used) == min(n, m)
        best = max(sum(gain[i, j] for i, j in zip(range(n), p, strict=False)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(gain[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(n), m))
        assert sum(gain[i, j] for i, j in enumerate(found) if j >= 0) == best


def test_clusters_go_to_persons():
    votes = np.array([[5.0, 1, 0], [4, 0, 1], [2, 2, 0], [0, 3, 3]])  # the first person owns two; equal votes go to who has none
    assert cluster_persons(votes).tolist() == [0, 0, 1, 2] and cluster_persons(np.array([[1.0]])).tolist() == [0]
    rng = np.random.default_rng(1)
    for _ in range(20):
        gain = rng.integers(0, 4, (4, 3)) + 0.0
        gain[:, 0] += gain.sum(1) == 0
        found = cluster_persons(gain)
        assert (gain[np.arange(4), found] == gain.max(1)).all()


def test_clean_turns(spark):
    people = spark.createDataFrame(PEOPLE, SCHEMA)
    rows = [
        ("s", "c", 1, 1000, 2000, "1-gotol.11", "A", "euh le moine"), ("s", "c", 2, 2500, 3000, "Inconnu", "A", "MJ : aveugle [rires]"), ("s", "c", 3, 3100, 3200, None, "A", "hum"),
        ("s", "c", 4, 6000, 6500, "Balkidra Prastone", "A", "oui"), ("s", "c", 5, 6600, 6700, "Maître du jeu :", "B", "non"), ("s", "c", 6, 6700, 6800, "???", "B", "encore"), ("s", "c", 7, 9000, 9100, "?", "Z", "personne"),
        ("s", "c", 8, None, 9100, "Thiwen", "A", "x"), ("s", "c", 9, 9950, 9990, "THIWEN", None, None), ("s", "c", 6, 6700, 6800, "???", "B", "encore"), ("s", None, 10, 99_000, 99_100, "Thiwen", None, "quoi"),
    ]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "session string, campaign string, turn_id int, s long, e long, speaker string, cluster string, text string, n_words int, person string")
    df = df.drop("n_words", "person")
    got = {(r.turn_id, r.person, r.n_rows, r.n_words) for r in clean_turns(df, people).collect()}
    assert got == {(1, "gotol.11", 2, 3), (4, "gotol.11", 1, 1), (5, "boss_1", 2, 2)}
    assert clean_turns(df.limit(0), people).count() == 0
    labels = spark.createDataFrame([("c", "Speaker 2"), ("c", None), (None, "MJ")], "campaign string, label string")
    assert resolve_labels(labels, people).count() == 0
