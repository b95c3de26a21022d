"""Literal cases and brute-force versions of core operators."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions.dice import dice_notation
from voxframe.operators import attribution, joins, lore, refine, timeline, turns, vectors
from voxframe.plans import registry
from voxframe.sources.render import render_markdown

DICE = [
    ("il lance deux dés six", "il lance 2d6"), ("lance un dé vingt", "lance 1d20"), ("fais un jet de dés 20", "fais un jet de 1d20"), ("il lance des dix", "il lance 1d10"), ("cinq dés de dix", "5d10"),
    ("il lance 2 d 6", "il lance 2d6"), ("un jet de délai", "un jet de dés"), ("des jets de délai", "des jets de dés"), ("fais des jets-dés", "fais des jets de dés"), ("lance un dé de 20", "lance 1d20"),
    ("fais trois dés de six", "fais 3d6"), ("lance un dé cent", "lance 1d100"), ("lance 1 dé 12", "lance 1d12"), ("un dé 4", "1d4"), ("jet d' initiative", "jet d'initiative"), ("lance 2d6 puis des dix", "lance 2d6 puis 1d10"),
    ("Lance des dix. Puis des dix", "Lance 1d10. Puis des dix"), ("  lance\ndes dix,  ok ", "  lance\n1d10,  ok "), ("il lance l'un dé six", "il lance l'un 1d6"), ("lance deux dés six et des dix puis des huit", "lance 2d6 et 1d10 puis 1d8"), (None, None),
]
UNCHANGED = [
    "il a eu deux des six votes", "c est une des dix merveilles", "pendant des 10 minutes", "chacun des 6 joueurs", "", "il y a 20 gardes", "des 20 gardes approchent", "trois des huit portes sont ouvertes",
    "un des vingt chevaliers est mort", "lance de six", " \n",
]


def test_dice(spark):
    cases = DICE + [(t, t) for t in UNCHANGED]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", dice_notation("t").alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: want for i, (_, want) in enumerate(cases)}


def fold(rows, gap):
    out = []
    for s, e, who, text in sorted(rows, key=lambda r: r[0]):
        if out and out[-1][2] == who and s - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], e), who, f"{out[-1][3]} {text}".strip())
        else:
            out.append((s, e, who, text))
    return sorted(map(repr, out))


def test_debounce_equals_fold(spark):
    rng = random.Random(3)
    rows = [(s, s + rng.randrange(0, 900_000), rng.choice("AB"), f"t{s}") for s in rng.sample(range(0, 9_000_000), 60)]
    df = spark.createDataFrame([("x", i, *r, False) for i, r in enumerate(rows)], "session_id string, turn_id int, start_ms long, end_ms long, speaker string, text string, uncertain boolean")
    got = turns.debounce(df, 100_000).select("start_ms", "end_ms", "speaker", "text").collect()
    assert sorted(repr(tuple(r)) for r in got) == fold(rows, 100_000)
    assert turns.debounce(df.limit(0)).count() == 0


def test_chain_renders(spark):
    df = spark.createDataFrame([("x", 0, 1000, 2000, "A", "hello", False), ("x", 1, 2500, 4000, "A", "again", False), ("x", 2, 5000, 7000, "B", None, True)], "session_id string, turn_id int, start_ms long, end_ms long, speaker string, text string, uncertain boolean")
    text = render_markdown(turns.debounce(df)).first().markdown
    assert text.startswith(refine.NOTICE) and "### [00:00:01 - 00:00:04] A\n\nhello again\n\n### [00:00:05 - 00:00:07] B\n" in text


def test_alignment_cases(spark):
    w = "session_id string, seq int, pos int, word string, start_ms long, end_ms long"
    t = "session_id string, id int, start_ms long, end_ms long, cluster_id string"
    words = [("max", 0, 0, "hello", 1000, 3000), ("tie", 0, 0, "hello", 5000, 6000)]
    words += [("near", 0, i, x, s, e) for i, (x, s, e) in enumerate([("before", 0, 1000), ("inside", 11_000, 12_000), ("gap", 16_000, 17_000), ("gap2", 18_500, 19_500), ("after", 30_000, 32_000)])]
    people = [("max", 4, 0, 2100, "A"), ("max", 5, 1500, 4000, "B"), ("tie", 4, 0, 10_000, "A"), ("tie", 5, 5000, 6000, "B"), ("near", 10, 10_000, 15_000, "A"), ("near", 20, 20_000, 25_000, "B")]
    got = timeline.align_words(spark.createDataFrame(words, w), spark.createDataFrame(people, t)).orderBy("session_id", "group_no").collect()
    assert [(r.session_id, r.turn_id, r.uncertain) for r in got] == [("max", 5, True), *(("near", i, False) for i in (10, 10, 10, 20, 20)), ("tie", 5, True)]


def test_nearest_turns_across_chunks(spark):
    rng, day = random.Random(8), 40_000_000
    spans = [(s, s + rng.randrange(1, 4) * 1000) for s in (rng.randrange(3, day // 1000) * 1000 for _ in range(40))]
    people = [("x", i, s, e, f"C{i}") for i, (s, e) in enumerate(spans)]
    asked = [("x", i, 2 * m) for i, m in enumerate([0, day * 2, *(rng.randrange(day // 1000) * 1000 for _ in range(80))]) if not any(s <= m <= e for s, e in spans)]
    groups = spark.createDataFrame([*asked, ("none", 0, 5)], "session_id string, group_no long, middle2 long")
    near = timeline._nearest_turn(groups, spark.createDataFrame(people, "session_id string, turn_id int, ts long, te long, cluster_id string"))
    got = {(r.session_id, r.group_no): r.near_id for r in near.collect()}
    want = {("x", g): min((abs((2 * e if 2 * e <= m else 2 * s) - m), s, i) for _, i, s, e, _ in people)[2] for _, g, m in asked}
    assert got == want | {("none", 0): None}
    plan = near._jdf.queryExecution().analyzed().toString()
    assert "__chunk" in plan and "windowspecdefinition(session_id" in plan and not re.search(r"windowspecdefinition\(session_id#\d+, at#", plan)


def test_points_and_spacing(spark):
    """A first word without length takes a turn that holds the middle; tokens are joined without their spaces."""
    w = "session_id string, seq int, pos int, word string, start_ms long, end_ms long"
    t = "session_id string, id int, start_ms long, end_ms long, cluster_id string"
    words = [("p", 0, 0, "now", 2000, 2000), ("q", 0, 0, " qu", 0, 200), ("q", 0, 1, "'il ", 200, 400), ("q", 0, 2, ",", 400, 400), ("q", 0, 3, " dit", 1000, 1200), ("q", 0, 4, "-il", 1200, 1400)]
    people = [("p", 1, 0, 2000, "A"), ("p", 2, 2000, 3000, "B"), ("p", 3, 1900, 2050, "C"), ("q", 1, 0, 200, "A"), ("q", 2, 200, 2000, "B")]
    groups = timeline.align_words(spark.createDataFrame(words, w), spark.createDataFrame(people, t))
    got = groups.orderBy("session_id", "group_no").collect()
    assert [(r.session_id, r.turn_id, r.uncertain, r.text) for r in got] == [("p", 3, True, "now"), ("q", 1, True, "qu'il,"), ("q", 2, False, "dit-il")]
    assert [r.text for r in timeline.aligned_runs(groups.filter("session_id = 'q'")).orderBy("run_no").collect()] == ["qu'il,", "dit-il"]


def test_runs_of_one_turn_get_new_ids(spark):
    rows = [("x", i, s, s + 1000, 1, f"w{i}", k, c, False) for i, (s, k, c) in enumerate([(1000, 4, "A"), (5000, 5, "B"), (8000, 4, "A")], 1)]
    df = spark.createDataFrame(rows, "session_id string, group_no long, start_ms long, end_ms long, n_words long, text string, turn_id int, cluster_id string, uncertain boolean")
    assert [(r.run_id, r.source_turn_id) for r in timeline.aligned_runs(df).orderBy("run_no").collect()] == [(4, 4), (5, 5), (6, 4)]


def test_propagation(spark):
    clusters = ["SPEAKER_99", "SPEAKER_00", "SPEAKER_88", "SPEAKER_01", "SPEAKER_77"]
    df = spark.createDataFrame([("x", i, i * 2_000_000, c) for i, c in enumerate(clusters)], "session_id string, turn_id int, start_ms long, cluster_id string")
    own = spark.createDataFrame([], "session_id string, turn_id int, name string")
    default = spark.createDataFrame([("x", "SPEAKER_00", "Brakk"), ("x", "SPEAKER_01", "Dorsa")], "session_id string, cluster_id string, name string")
    got = {r.turn_id: r.name for r in attribution.propagate_labels(df, own, default).collect()}
    assert got == {0: "Brakk", 2: "Brakk", 4: "Dorsa"}


def test_linkage_against_brute_force():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(14, 3))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(14)]
    while len(groups) > 4:
        mean = lambda p: np.mean([1 - u[i] @ u[j] for i in groups[p[0]] for j in groups[p[1]]])
        a, b = min(itertools.combinations(range(len(groups)), 2), key=mean)
        groups[a] += groups.pop(b)
    label = vectors.average_linkage(v, 4, None)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(label == k)) for k in set(label)}
    assert len(set(vectors.average_linkage(np.array([[1.0, 0], [0, 1], [0.9, 0.1]]), 2, None))) == 2
    assert vectors.average_linkage(np.zeros((0, 2)), 1, None).tolist() == []


def test_large_sessions_are_linked_in_rounds(spark):
    """The same clusters whether a session is one task or merged in rounds, block by block."""
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", i, (rng.normal(size=4) + 2 * rng.normal(size=4).round()).tolist()) for k in range(2) for i in range(60)] + [("s0", 99, None), ("tiny", 5, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "session_id string, id long, vector array<double>")
    one = sorted(map(tuple, vectors.recluster(df, None, 0.4).collect()))
    assert sorted(map(tuple, vectors.recluster(df, None, 0.4, most=10).collect())) == one and 3 < len({r[2] for r in one}) < 60
    small = vectors.linked_in_rounds(df.filter("vector is not null"), 0.4, 7).collect()
    groups = lambda pairs: {frozenset(i for s, i, c in pairs if (s, c) == k) for k in {(s, c) for s, _, c in pairs}}
    assert groups([tuple(r) for r in small]) == groups(one)
    with pytest.raises(ValueError, match="fixed number"):
        vectors.recluster(df, 3, None, most=10)


def test_profiles(spark):
    samples = spark.createDataFrame([("Brakk", "a", [1.0, 0.0]), ("Brakk", "b", [0.8, 0.6]), ("Merrow", "c", [0.0, 1.0])], "speaker string, sample_id string, vector array<double>")
    none = spark.createDataFrame([], "speaker string, centroid array<double>, sample_count long, sample_ids array<string>")
    first = vectors.enrol(samples, none)
    counts = {r.speaker: r.sample_count for r in first.collect()}
    assert counts == {"Brakk": 2, "Merrow": 1}
    again = {r.speaker: (r.sample_count, r.centroid) for r in vectors.enrol(samples, first).collect()}
    assert again == {r.speaker: (r.sample_count, r.centroid) for r in first.collect()}
    profiles = first.select(F.when(F.col("speaker") == "Brakk", 0).otherwise(1).alias("ord"), "speaker", F.col("centroid").alias("vector"))
    queries = spark.createDataFrame([("p", [0.99, 0.05]), ("q", [0.02, 0.99]), ("r", [-1.0, 0.0]), ("n", None)], "query string, vector array<double>")
    assert {(r.query, r.speaker) for r in vectors.best_profiles(queries, profiles).collect()} == {("p", "Brakk"), ("q", "Merrow")}


def test_packing_skips_and_goes_on(spark):
    terms = [("g", f"t{'x' * (i * 7 % 13)}{i}", i) for i in range(30)]
    size, want = 2, []
    for _, t, _ in terms:
        more = len(t) + 2 + bool(want)
        if size + more <= 120:
            want, size = [*want, t], size + more
    got = lore.pack_reference(spark.createDataFrame(terms, "g string, term string, rank int"), ["g"], 120).first()
    assert list(got.terms) == want and got.n_chars == size


def test_packing_reads_past_the_first_ranks(spark):
    rng, rows, want = random.Random(5), [], {}
    groups = {"late": ["x" * 19 + str(i % 10) + "y" * (i // 10) for i in range(60)] + ["ab", "c"], "long": ["z" * 99], "random": ["".join(rng.choices("abc", k=rng.choice([1, 2, 3, 9, 25, 40]))) for _ in range(300)]}
    for g, names in groups.items():
        size, want[g] = 2, ([], 2)
        for i, t in enumerate(dict.fromkeys(names)):
            rows.append((g, t, i))
            if (more := len(t) + 2 + bool(want[g][0])) + size <= 30:
                size += more
                want[g] = ([*want[g][0], t], size)
    got = lore.pack_reference(spark.createDataFrame(rows, "g string, term string, rank int"), ["g"], 30).collect()
    assert {r.g: (list(r.terms), r.n_chars) for r in got} == want and "ab" in want["late"][0] and want["long"] == ([], 2)


def test_callouts_of_all_texts(spark, tmp_path):
    texts = ["> [!note] head\n> one\n>two\n  > three\nfour", "a\r\n> b\r\nc", "  > [!warning]\n\n> > deep", "[!x] plain\nrest", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = {r.doc_id: (r.digest, r.wrapped_digest) for r in registry.queries()["callout_strip_all"](spark, str(tmp_path)).collect()}
    want = ["one\ntwo\nthree\nfour", "a\r\nb\r\nc", "\n> deep", "[!x] plain\nrest", ""]
    wrapped = [*texts[:3], "rest", ""]
    assert got == {i: (digest(a), digest(b)) for i, (a, b) in enumerate(zip(want, wrapped, strict=True))}


def test_refinement(spark):
    a = "### [00:00:01 - 00:00:02] A\n\none two three\n"
    df = spark.createDataFrame([(1, a), (2, "")], "doc_id int, text string")
    asked = refine.refine_chunks(df, lambda t: t.replace("two", "2"))
    assert {r.doc_id: (r.text, r.reason) for r in asked.collect()}[1] == (a.strip().replace("two", "2"), None)
    broken = refine.refine_chunks(df, lambda t: 1 / 0)
    assert {r.reason for r in broken.collect()} == {"no answer"}
    ratio = spark.createDataFrame([("abcd", "abxd"), (None, "x")], "a string, b string").select(refine.likeness("a", "b").alias("r")).collect()
    assert [r.r for r in ratio] == [0.75, None]


def test_profiles_of_other_sizes(spark):
    """A query meets the profiles of its size, wherever it stands among the others."""
    profiles = spark.createDataFrame([(0, "A", [1.0, 0.0]), (1, "B", [0.0, 1.0]), (2, "C", [1.0, 0.0, 0.0]), (3, "D", None)], "ord int, speaker string, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", [1.0, 0.1] if i % 2 else [1.0, 0.1, 0.0]) for i in range(6)], "query string, vector array<double>")
    assert {(r.query, r.speaker) for r in vectors.best_profiles(queries, profiles).collect()} == {(f"q{i}", "A" if i % 2 else "C") for i in range(6)}


def test_control_tokens(spark):
    cases = [("<<|endoftext|>|endoftext|>", ""), ("<<<|startoftranscript|>|>", ""), ("<|<|startoftranscript|>|>", ""), ("prefix<|<|foo|>|>suffix", "prefixsuffix"), ("orphan<|", "orphan"), ("|>tokens", "tokens"), ("orphan<||>tokens", "orphantokens"), ("<|" * 12 + "x" + "|>" * 12 + "y", "y"), ("a<|b<c|>d", "ad"), (None, None), ("", "")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", lore.strip_control_tokens(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: want for i, (_, want) in enumerate(cases)}


def test_cluster_samples_are_the_first(spark):
    df = spark.createDataFrame([("s", "a", 199 - i, i, 0, 1000, f"t{199 - i}") for i in range(200)] + [("s", None, 1, 500, 0, 5, "n")], "session_id string, cluster_id string, seq int, turn_id int, start_ms long, end_ms long, text string")
    got = {r.cluster_id: (r.n_turns, r.total_ms, list(r.samples)) for r in turns.cluster_stats(df).collect()}
    assert got == {"a": (200, 200_000, ["t0", "t1", "t2", "t3"]), None: (1, 5, ["n"])}


@pytest.mark.parametrize("hot", [3, 100_000])
def test_hot_keys_are_spread(spark, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 20), (3, 21), (None, 22)], "k int, id int")
    small = rows.filter("k < 3").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    assert sorted(map(tuple, joins.joined_spread(rows, small, ["k"], "id").collect())) == [(1, i, 20, 0) for i in range(20)] + [(2, 20, 1, 20)]
    assert sorted(r.id for r in joins.joined_spread(rows, small, ["k"], "id", "left").filter("n is null").collect()) == [21, 22]
