from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from voxframe.llm import queries, runs
from voxframe.llm.nearest_time import nearest_in_time, trie_neighbours
from voxframe.llm.runs import collapse_runs, folded_label, label_distance, segment


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    same(connect(small), queries.QUERIES[name](spark, small), queries.ORACLES[name])


def test_trie_equals_search():
    rng = np.random.default_rng(0)
    for n, bits in ((0, 4), (1, 4), (40, 7), (900, 12)):
        keys = np.unique(rng.integers(0, 1 << (bits + 2), n))  # four entities of 2^bits ticks
        asked = rng.integers(0, 1 << (bits + 2), 300)
        below, above = trie_neighbours(keys, asked, bits)
        for q, b, a in zip(asked, below, above, strict=True):
            own = [i for i, k in enumerate(keys) if k >> bits == q >> bits]
            assert b == max((i for i in own if keys[i] <= q), default=-1)
            assert a == min((i for i in own if keys[i] > q), default=-1)


def test_nearest_in_time(spark):
    rng = random.Random(2)
    events = [(rng.choice("ab"), rng.randrange(4000), rng.randrange(3), rng.randrange(3), 0) for _ in range(150)]
    asked = [(rng.choice("abc"), rng.randrange(4000), "extra") for _ in range(120)] + [(None, 3, ""), ("a", None, "")]
    events += events[:9] + [(None, 5, 0, 0, 0), ("a", None, 0, 0, 0)]
    e = spark.createDataFrame(events, "entity string, tick long, rank_a long, rank_b long, stretch int")
    q = spark.createDataFrame(asked, "entity string, tick long, kind string")
    want = set()
    for k, t, _ in asked:
        near = min(((abs(x[1] - t), x[1], x[2], x[3]) for x in events if k is not None and t is not None and x[0] == k and x[1] is not None), default=None)
        if near and near[0] <= 12:
            want.add((k, t, *near[1:]))
    assert {tuple(r) for r in nearest_in_time(q, e, 12, 6).collect()} == want
    assert nearest_in_time(q.limit(0), e, 12, 6).count() == 0 and nearest_in_time(q, e.limit(0), 12, 6).count() == 0
    with pytest.raises(ValueError, match="quarter"):
        nearest_in_time(q, e, 20, 6)


def brute_runs(rows, gap):
    out = {}
    for r in {x for x in rows if None not in (x[0], x[1], x[3], x[4])}:
        out.setdefault(r[0], []).append(r)
    found = set()
    for k, events in out.items():
        run = None
        for _, s, e, i, label in sorted(events, key=lambda r: (r[1], r[3])):
            e = s if e is None else e
            if run and run[0] == label and s <= run[4] + gap:
                run = (label, run[1], i, run[3], max(run[4], e), run[5] + 1)
            else:
                if run:
                    found.add((k, *run))
                run = (label, i, i, s, e, 1)
        found.add((k, *run))
    return found


def test_runs_equal_brute_force_over_chunk_borders(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), s := rng.randrange(3000), rng.choice([s + rng.randrange(600), s + 5, None]), i, rng.choice("xxxy")) for i in range(140)]
    rows += rows[:15] + [(None, 1, 2, 900, "x"), ("a", None, 2, 901, "x"), ("a", 1, 2, 902, None), ("c", 0, 5000, 903, "x"), ("c", 2900, 2901, 904, "x"), ("c", 2950, 2960, 905, "x")]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], "session string, s long, e long, id long, who string, n_rows int, label string")
    for chunk in (50, 500, 100_000):
        got = collapse_runs(df, "session", "s", "e", "id", "who", 20, chunk_ms=chunk)
        assert {tuple(r) for r in got.select("session", "label", "first_key", "last_key", "start_ms", "end_ms", "n_rows").collect()} == brute_runs(rows, 20)
    assert collapse_runs(df.limit(0), "session", "s", "e", "id", "who").count() == 0


def test_segmentation_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 7
        s, label = np.cumsum(rng.integers(0, 5, n)), rng.integers(0, 2, n)
        e = s + rng.integers(0, 6, n)

        def cost(cuts):
            total, begin = 0.0, 0
            for end in [*cuts, n]:
                latest = e[begin]
                for i in range(begin + 1, end):
                    total += 2.0 * (label[i] != label[i - 1] or s[i] - latest > 2)
                    latest = max(latest, e[i])
                total, begin = total + 1, end
            return total

        best = min(cost([i for i in range(1, n) if mask >> i & 1]) for mask in range(0, 1 << n, 2))
        run = segment(s, e, label, np.zeros(n), 2)
        assert cost([i for i in range(1, n) if run[i] != run[i - 1]]) == best


def test_labels_fold(spark):
    df = spark.createDataFrame([("Tolsénze  Pralande.",), ("TOLSÉNZE_PRALANDE :",), ("?!",), (None,), ("Œuvre",)], "a string")
    assert [r.a for r in df.select(folded_label("a").alias("a")).collect()] == ["tolsenzepralande", "tolsenzepralande", None, None, "oeuvre"]


def test_near_identical_labels_are_one_run(spark):
    rows = [("s", i * 100, i * 100 + 50, i, w) for i, w in enumerate(["merrow", "merow", "merrow", "tessaro", "tesaro", "tessaro", "bob", "merow", "merrow", "merrow"])]
    df = spark.createDataFrame(rows, "session string, s long, e long, id long, who string")
    runs = lambda alike, chunk: sorted((r.first_key, r.last_key, r.label, r.n_rows) for r in collapse_runs(df, "session", "s", "e", "id", "who", 2000, chunk_ms=chunk, alike=alike).collect())
    assert runs(0.34, 1_800_000) == [(0, 2, "merrow", 3), (3, 5, "tessaro", 3), (6, 6, "bob", 1), (7, 9, "merrow", 3)]
    assert len(runs(0.0, 1_800_000)) == 9 and [r[3] for r in runs(0.34, 300)] == [3, 3, 1, 3]


def test_graded_segmentation_is_optimal():
    rng = np.random.default_rng(4)
    words = ["merrow", "merow", "merrows", "tessaro", "tesaro"]
    for _ in range(30):
        n, alike = 7, 0.4
        s, label = np.cumsum(rng.integers(0, 5, n)), np.array(rng.choice(words, n), object)
        e = s + rng.integers(0, 6, n)
        pair = lambda a, b, x=alike: d / x if (d := label_distance(a, b)) <= x else 2.0

        def cost(cuts):
            total, begin = 0.0, 0
            for end in [*cuts, n]:
                latest, late = e[begin], 0.0
                for i in range(begin + 1, end):
                    late += 2.0 * (s[i] - latest > 2)
                    latest = max(latest, e[i])
                total, begin = total + 1 + late + min(sum(pair(x, own) for x in label[begin:end]) for own in label[begin:end]), end
            return total

        best = min(cost([i for i in range(1, n) if mask >> i & 1]) for mask in range(0, 1 << n, 2))
        run = segment(s, e, label, np.zeros(n), 2, alike)
        assert abs(cost([i for i in range(1, n) if run[i] != run[i - 1]]) - best) < 1e-9


def test_session_of_one_label_is_spread(spark):
    """Every run of a session with one speaker lies at a border of its chunk; they are joined chunk by chunk, not in one task."""
    rows = spark.range(6000).select(F.lit("s").alias("session"), (F.col("id") * 5000).alias("s"), (F.col("id") * 5000 + F.when(F.col("id") == 700, 9_000_000).otherwise(1000)).alias("e"), "id", F.lit("x").alias("who"))
    got = collapse_runs(rows, "session", "s", "e", "id", "who", 2000)
    found = {(r.first_key, r.last_key, r.n_rows) for r in got.collect()}
    long = (700, 2500, 1801)  # over five chunks
    assert long in found and len(found) == 6000 - 1800 and all(a == b for a, b, n in found - {long})
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(__group" not in plan and "windowspecdefinition(__entity#" in plan


def test_batches_of_any_size(spark):
    """A stretch of events isn't cut by the batches in which they reach Python."""
    rng = random.Random(9)
    rows = [("s", i * 100, i * 100 + rng.randrange(150), i, rng.choice(["merrow", "merow", "merrow", "bob"])) for i in range(120)]
    df = spark.createDataFrame(rows, "session string, s long, e long, id long, who string")
    runs = lambda: sorted(tuple(r) for r in collapse_runs(df, "session", "s", "e", "id", "who", 20, alike=0.34).collect())
    whole = runs()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert runs() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_labels_come_from_the_program(monkeypatch):
    """The program decides every boundary within a stretch without a pause, also where labels have to be equal."""
    seen = []
    program = runs._optimal
    monkeypatch.setattr(runs, "_optimal", lambda *a: seen.append(a[2]) or program(*a))
    labels = np.array(list("aabaababxyyxx"), object)
    s = np.arange(len(labels)) * 10
    s[9:] += 5000
    assert segment(s, s + 5, labels, np.zeros(len(labels)), 2000).tolist() == [0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 7, 8, 8]
    assert ["".join(x) for x in seen] == ["aabaababx", "yyxx"]
