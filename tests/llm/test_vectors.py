from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm.clusters import linked, similarity_clusters
from voxframe.llm.components import components
from voxframe.llm.neighbours import best_pairs, similar_vectors
from voxframe.llm.vectors import pack, unpack
from voxframe.operators import joins

SCHEMA = "ord int, v array<float>, id string, cell int"


def voices(n=240, size=8, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6, size))
    v = centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, size)) * 0.15
    v[5] = v[3] = v[1]  # exact copies
    v[9] = v[7] * 3
    return v.astype(np.float32).astype(float)


def table(spark, v, size):
    rows = [(i, x.tolist(), "x", 1) for i, x in enumerate(v)]
    rows += [rows[0], rows[3], (None, [1.0] * size, "", 0), (900, None, "", 0), (901, [], "", 0), (902, [0.0] * size, "", 0), (903, [1.0, None] + [1.0] * (size - 2), "", 0), (904, [1.0], "", 0), (905, [float("nan")] * size, "", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


def test_packing_is_close():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(50, 8))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    back = unpack(pack(u), 8)
    assert np.abs(back - u).max() < 1.1e-6 and unpack(pack(u[:0]), 8).shape == (0, 8)
    assert np.abs((back @ back.T) - u @ u.T).max() < 4e-6


def components_of(links, n):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_clusters_equal_brute_force(spark):
    v = voices()
    c = cosines(v)
    want = components_of([(i, j) for i in range(len(v)) for j in range(len(v)) if i < j and c[i, j] >= 0.9], len(v))
    for rows in (60_000, 12):  # 12: all cells are hot and cut into slices
        members, typical = similarity_clusters(table(spark, v, 8), "ord", "v", 0.9, 8, rows)
        got = {r.id: (r.root, r.n) for r in members.collect()}
        right = sum(got[i] == (want[i], want.count(want[i])) for i in range(len(v)))
        assert len(got) == len(v) and right >= 0.97 * len(v)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for r in typical.collect():
        own = [i for i in range(len(v)) if got[i][0] == r.root]
        close = u[own] @ u[own].sum(0) / np.linalg.norm(u[own].sum(0))
        assert len(own) >= 3 and close[own.index(r.id)] >= close.max() - 1e-5


def test_neighbours_reach_recall(spark):
    v = voices(400, 16, 1)
    c = cosines(v)
    np.fill_diagonal(c, -1)
    want = {(i, j) for i in range(len(v)) for j in sorted(range(len(v)), key=lambda j: (-round(c[i, j], 6), j))[:5] if c[i, j] >= 0.8}
    for rows in (60_000, 15):  # 15: hot buckets are cut into slices
        got = {(r.id, r.other) for r in similar_vectors(table(spark, v, 16), "ord", "v", 5, 0.8, 16, bucket_rows=rows).collect()}
        assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
        assert {(1, 3), (1, 5), (3, 1), (3, 5), (5, 1), (5, 3)} <= got


def test_empty_tables(spark):
    none = table(spark, voices(), 8).limit(0)
    members, typical = similarity_clusters(none, "ord", "v", 0.8, 8)
    assert members.count() == typical.count() == similar_vectors(none, "ord", "v", 5, 0.8, 8).count() == 0


def test_many_copies(spark):
    """A vector that is most of all rows enters as one."""
    df = spark.createDataFrame([(i, [1.0, 0.0], "", 0) for i in range(60)] + [(60, [0.9, 0.1], "", 0), (61, [0.0, 1.0], "", 0)], SCHEMA)
    members, typical = similarity_clusters(df, "ord", "v", 0.8, 2)
    assert {(r.root, r.n) for r in members.collect()} == {(0, 61), (61, 1)} and [r.id for r in typical.collect()] == [0]
    got = {(r.id, r.other) for r in similar_vectors(df, "ord", "v", 5, 0.8, 2).collect()}
    assert {o for i, o in got if i == 40} == {0, 1, 2, 3, 4} and {o for i, o in got if i == 2} == {0, 1, 3, 4, 5} and {o for i, o in got if i == 60} == {0, 1, 2, 3, 4}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(100, 130)]
    got = {r.id: r.root for r in components(spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")).collect()}
    want = components_of(links, 131)
    assert got == {i: want[i] for i in range(131) if want[i] != i}


def test_linked_and_best_pairs():
    v = voices(200, 8, 4)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    assert linked(u, 0.9).tolist() == components_of([(i, j) for i in range(200) for j in range(i) if c[i, j] >= 0.9], 200)
    i, j = best_pairs(u, None, 3, 0.8)
    np.fill_diagonal(c, -1)
    edge = np.sort(c, 1)[:, -3]
    assert {(a, b) for a in range(200) for b in range(200) if c[a, b] >= max(0.8, edge[a])} <= set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("n", [0, 1])
def test_few(n):
    assert linked(np.ones((n, 2)), 0.8).tolist() == list(range(n))
    assert best_pairs(np.ones((n, 2)), None, 5, 0.8)[0].tolist() == []


def test_near_copies_stay_few():
    """Vectors that are alike but for rounding keep 2 k pairs each, not all."""
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(1, 8)), 5000, 0) * rng.uniform(0.5, 2, (5000, 1))
    v += rng.normal(size=v.shape) * 1e-8
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = best_pairs(u, None, 5, 0.8)
    assert len(i) == 50_000 and {(9, 0), (9, 1), (9, 2), (9, 3), (9, 4)} <= set(zip(i[i == 9].tolist(), j[i == 9].tolist(), strict=True))
    assert linked(u, 0.8).tolist() == [0] * 5000


def test_rescaled_vectors_are_copies(spark):
    base = np.random.default_rng(5).normal(size=8)
    rows = [(i, (base * (1 + i)).tolist(), "", 0) for i in range(50)] + [(50, (-base).tolist(), "", 0)]
    members, _ = similarity_clusters(spark.createDataFrame(rows, "ord int, v array<double>, id string, cell int"), "ord", "v", 0.8, 8)
    assert {(r.root, r.n) for r in members.collect()} == {(0, 50), (50, 1)}


def test_sides_are_compared_with_each_other():
    v = voices(150, 8, 6)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c, side = u @ u.T, np.random.default_rng(1).integers(0, 2, 150)
    across = [(i, j) for i in range(150) for j in range(i) if c[i, j] >= 0.9 and side[i] != side[j]]
    every = components_of([(i, j) for i in range(150) for j in range(i) if c[i, j] >= 0.9], 150)
    got = linked(u, 0.9, side).tolist()
    assert all(got[i] == got[j] for i, j in across) and all(every[i] == every[g] for i, g in enumerate(got))


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    v = voices()
    first = {r.id: (r.root, r.n) for r in similarity_clusters(table(spark, v, 8), "ord", "v", 0.9, 8)[0].collect()}
    monkeypatch.setattr(joins, "HOT_ROWS", 100_000)
    assert first == {r.id: (r.root, r.n) for r in similarity_clusters(table(spark, v, 8), "ord", "v", 0.9, 8)[0].collect()}
