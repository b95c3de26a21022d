"""The most similar vectors of every vector, by multi-probe hashing with p-stable projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.vectors import exact_copies, grouped, packed_units, pair_tasks, unpack, vector_rows, without_copies
from voxframe.operators.joins import joined_spread

TABLES, WIDTH, SEED = 2, 3.0, 17
#: Rows of a bucket compared in one task; a larger bucket is cut into slices, and each pair of slices is a task.
BUCKET_ROWS = 60_000
BLOCK = 2048
#: Boundaries considered for perturbation, and the most of them crossed at once.
NEAR_BOUNDARIES, MOST_CROSSED = 6, 3


def hashing(n: int) -> tuple[int, int]:
    """Hashes of a table and probes of a vector for ``n`` vectors: buckets grow as about the square root of n, and longer keys get more probes."""
    hashes = max(6, round(10 + 1.1 * log(max(n, 1) / 120_000)))
    return hashes, 3 + max(0, hashes - 10) // 2


def probe_keys(units: np.ndarray, hashes: int, probes: int, table: int, seed: int = SEED) -> np.ndarray:
    """Bucket keys (vectors x probes): the home bucket, then perturbed ones in the order of their estimated success.

    Crossing a boundary is the likelier the nearer the projection lies to it; the score of a set of crossings is the
    sum of the squared distances.
    """
    rng = np.random.default_rng((seed, table))
    shift = rng.uniform(0, WIDTH, hashes)
    at = (units @ rng.normal(size=(units.shape[1], hashes)) + shift) / WIDTH
    cell = np.floor(at).astype(np.int64)
    weight = rng.integers(1, 1 << 62, hashes, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        home = (cell * weight).sum(1) + np.int64(table)
        below = at - cell
        score = np.concatenate([below**2, (1 - below) ** 2], 1)
        step = np.concatenate([-weight, weight])
        near = np.argsort(score, 1)[:, : min(NEAR_BOUNDARIES, 2 * hashes)]
        scores, steps, dims = np.take_along_axis(score, near, 1), step[near], near % hashes
        sets = [()] + [c for r in range(1, MOST_CROSSED + 1) for c in combinations(range(near.shape[1]), r)]
        cost = np.zeros((len(units), len(sets)))
        moved = np.zeros((len(units), len(sets)), np.int64)
        for i, crossed in enumerate(sets[1:], 1):
            own = list(crossed)
            cost[:, i] = scores[:, own].sum(1)
            moved[:, i] = steps[:, own].sum(1)
            for a, b in combinations(own, 2):  # both sides of one cell can't be crossed
                cost[dims[:, a] == dims[:, b], i] = np.inf
        best = np.argsort(cost, 1)[:, :probes]
        return home[:, None] + np.take_along_axis(moved, best, 1)


def _placed(size: int, hashes: int, probes: int, tables: int, with_unit: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unpack(batch.column("unit"), size)
            keys = np.concatenate([probe_keys(units, hashes, probes, t) for t in range(tables)], 1)
            if not with_unit:
                yield pa.record_batch([pa.array(keys.ravel())], names=["bucket"])
                continue
            for k in range(keys.shape[1]):
                yield pa.record_batch([pa.array(np.ascontiguousarray(keys[:, k])), batch.column("id"), batch.column("unit")], names=["bucket", "id", "unit"])

    return run


def _firsts(x: np.ndarray, count: int) -> np.ndarray:
    """Which ``count`` values of each row are the greatest; values within a millionth are equal, and then the earlier column is taken."""
    width = x.shape[1]
    key = np.rint(x * 1e6).astype(np.int64) * width - np.arange(width)
    edge = np.partition(key, width - count, 1)[:, width - count]
    return key >= edge[:, None]


def best_pairs(units: np.ndarray, side: np.ndarray | None, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i != j, where j is among the 2 k most similar rows of i with a cosine of ``least`` or more (within a millionth: the earlier row).

    Twice k, so that exact cosines decide about the k. However many rows are alike, at most 2 k of them are kept for each
    row of each block. With ``side``, only rows of different sides are compared.
    """
    small = units.astype(np.float32)
    n, low, most = len(units), np.float32(least - 1e-5), 2 * k
    tops: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            if side is not None and side[a : a + BLOCK].min() == side[a : a + BLOCK].max() == side[b : b + BLOCK].min() == side[b : b + BLOCK].max():
                continue
            s = small[a : a + BLOCK] @ small[b : b + BLOCK].T
            if side is not None:
                s[side[a : a + BLOCK, None] == side[None, b : b + BLOCK]] = -2
            if a == b:
                np.fill_diagonal(s, -2)
            for x, first, second in ((s, a, b), (s.T, b, a))[: 1 + (a != b)]:
                hit = x >= low
                many = np.flatnonzero(hit.sum(1) > most) if x.shape[1] > most else np.zeros(0, int)
                if len(many):
                    hit[many] &= _firsts(x[many], most)
                i, j = np.nonzero(hit)
                tops.append((i + first, j + second, x[i, j]))
    if not tops:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, c = (np.concatenate(x) for x in zip(*tops, strict=True))
    order = np.lexsort((j, -np.rint(c * 1e6), i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[keep], j[keep]


def _bucket(size: int, k: int, least: float):
    schema = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.struct([("away", pa.float64()), ("id", pa.int64())])))])

    def solve(_: int, rows: pa.Table) -> pa.RecordBatch | None:
        ids, first = np.unique(rows.column("id").to_numpy(), return_index=True)
        if len(ids) < 2:
            return None
        rows = rows.take(pa.array(first))
        side = rows.column("side").to_numpy()
        units = unpack(rows.column("unit"), size)
        two = side.min() != side.max()
        if two:  # sides together, so that blocks of one side are skipped
            order = np.argsort(side, kind="stable")
            ids, units, side = ids[order], units[order], side[order]
        i, j = best_pairs(units, side if two else None, k, least)
        cosine = np.einsum("ij,ij->i", units[i], units[j])
        good = np.flatnonzero(cosine >= least)
        good = good[np.lexsort((ids[j[good]], -cosine[good], i[good]))]
        good = good[np.arange(len(good)) - np.searchsorted(i[good], i[good]) < k]  # the k of a bucket hold those of all buckets
        i, j, cosine = i[good], j[good], cosine[good]
        if not len(i):
            return None
        heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        near = pa.StructArray.from_arrays([pa.array(-cosine), pa.array(ids[j])], names=["away", "id"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(i)].astype(np.int32)), near)
        return pa.record_batch([pa.array(ids[i[heads]]), lists], schema=schema)

    return grouped(solve, "task")


def similar_vectors(df: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.8, size: int = 64, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``id, rank, other, cosine``: up to ``k`` most similar others of each vector, with a cosine of ``least`` or more.

    Rows with a null id, a null vector or element, another size, NaN or only zeros are left out; a repeated id counts
    once; ties are ordered by the smaller id. An empty table gives no rows; other columns are ignored.

    Each vector visits its home bucket and the likeliest perturbed buckets of each table; in a bucket all visitors are
    compared exactly. The hashing loses some pairs (README has the measured recall). Copies are found by the hash of their
    packed unit vectors and enter as one vector; cosines within a millionth are equal. A bucket above ``bucket_rows`` is
    cut into slices, each pair of slices being a task.
    """
    rows = vector_rows(df, key, vector, size)
    everything = packed_units(rows, size)
    copies = exact_copies(everything)
    any_copies = not copies.isEmpty()
    distinct = without_copies(everything, copies) if any_copies else everything
    hashes, probes = hashing(rows.count())
    counts = distinct.mapInArrow(_placed(size, hashes, probes, tables, False), "bucket long").groupBy("bucket").count()
    placed = distinct.mapInArrow(_placed(size, hashes, probes, tables, True), "bucket long, id long, unit binary")
    tasks = pair_tasks(placed, counts, "bucket", bucket_rows)
    near = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_bucket(size, k, least), "id long, near array<struct<away: double, id: long>>")
    # a list of a bucket has at most k members, so a list of all buckets stays short
    best = near.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    if any_copies:
        best = _with_copies(best, copies, k)
    ranked = best.select("id", F.posexplode(F.slice("near", 1, k)).alias("pos", "x"))
    return ranked.select("id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("other"), (-F.col("x.away")).alias("cosine"))


def _with_copies(best: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Lists of every id, where a vector stands for all ids that have it; only the k + 1 smallest of them can be chosen."""
    order = Window.partitionBy("rep", "slice").orderBy("id")
    members = copies.select("rep", "id").unionByName(copies.select("rep", F.col("rep").alias("id")).distinct())
    small = members.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    firsts = small.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("firsts"))
    wide = best.select("id", F.explode(F.slice("near", 1, k + 1)).alias("x")).select("id", "x.away", F.col("x.id").alias("rep"))
    counted = firsts.join(copies.groupBy("rep").agg((F.count("*") + 1).alias("n")), "rep")
    others = wide.join(firsts, "rep", "left").select("id", "away", F.explode(F.coalesce("firsts", F.array("rep"))).alias("other"))
    own = firsts.select(F.col("rep").alias("id"), F.lit(-1.0).alias("away"), F.explode("firsts").alias("other"))
    lists = others.unionByName(own).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("away", F.col("other").alias("id")))), 1, k + 1).alias("near"))
    # the list of a vector is that of all its copies
    copied = joined_spread(members, lists.withColumnRenamed("id", "rep").join(counted.select("rep", "n"), "rep"), ["rep"], "id").select("id", "near")
    everyone = copied.unionByName(lists.join(counted.select(F.col("rep").alias("id")), "id", "left_anti"))
    return everyone.select("id", F.filter("near", lambda x: x["id"] != F.col("id")).alias("near"))
