from __future__ import annotations

import random

from voxframe.operators.intervals import merge_intervals, periods_and_gaps

SCHEMA = "entity string, s long, e long, id long, start_ms long, n_rows string"


def brute(rows):
    found = {}
    for k, s, e, i in {r for r in rows if None not in r[:3] and r[2] > r[1]}:
        found.setdefault(k, []).append((s, e, i))
    out = set()
    for k, r in found.items():
        at = None
        for s, e, _ in sorted(r, key=lambda x: (x[0], x[1])):
            if at and s <= at[1]:
                at[1], at[2] = max(at[1], e), at[2] + 1
            else:
                if at:
                    out.add((k, *at))
                at = [s, e, 1]
        out.add((k, *at))
    return out


def periods(spark, rows, chunk_ms):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {(r[0], r.start_ms, r.end_ms, r.n_rows) for r in merge_intervals(df, ["entity"], "s", "e", "id", chunk_ms).collect()}


def test_against_brute_force_over_chunk_borders(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), s := rng.randrange(400), s + rng.randrange(-2, 30), i) for i in range(150)]
    rows += rows[:20] + [(None, 1, 2, 900), ("a", None, 2, 901), ("a", 1, None, 902), ("d", 5, 300, 903), ("d", 250, 260, 904), ("d", 300, 301, 905)]
    for chunk in (10, 100, 10_000):
        assert periods(spark, rows, chunk) == brute(rows)


def test_empty_table_and_gaps(spark):
    assert periods(spark, [], 100) == set()
    df = spark.createDataFrame([("a", 0, 10, 1, 0, ""), ("a", 10, 20, 2, 0, ""), ("a", 25, 30, 3, 0, ""), ("a", 90, 99, 4, 0, "")], SCHEMA)
    found = periods_and_gaps(merge_intervals(df, ["entity"], "s", "e", "id"), ["entity"], 2, 10)
    assert {tuple(r) for r in found.collect()} == {("a", "period", 0, 20), ("a", "gap", 20, 25)}
