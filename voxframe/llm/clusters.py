"""Clusters of similar vectors, by distributed k-means cells with parallel oversampled seeding and exact linking in the cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.components import components
from voxframe.llm.vectors import exact_copies, grouped, packed_units, pair_tasks, unpack, vector_rows, without_copies
from voxframe.operators.joins import joined_spread
from voxframe.session import cut

#: Cells that each vector enters; rounds of seeding and of moving the centres.
ENTERED, SEED_ROUNDS, MOVES, SEED = 4, 2, 3, 23
#: Rows of a cell linked in one task; a larger cell is cut into slices, and each pair of slices is a task.
CELL_ROWS = 60_000
#: Rows of a task taken as leaders of tight groups before the pairs are compared.
LEADERS = 64
#: Members of a cluster summed in one group.
SLICE_ROWS = 50_000
BLOCK = 2048

Batches = Iterator[pa.RecordBatch]


def _chance(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each id, the same in whatever partition it lies (mixing steps of splitmix64; fixed values)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _nearest(units: np.ndarray, centres: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` centres with the greatest cosine, best first, and the best cosine."""
    cosine = units.astype(np.float32) @ centres.astype(np.float32).T
    count = min(count, len(centres))
    if count == 1:
        best = cosine.argmax(1)[:, None]
    else:
        best = np.argpartition(-cosine, count - 1, 1)[:, :count]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(cosine, best, 1), 1, kind="stable"), 1)
    return best, np.take_along_axis(cosine, best[:, :1], 1)[:, 0]


def _oversampled(size: int, centres: np.ndarray, rate: float, seed: int) -> Callable[[Batches], Batches]:
    """A partition's cost (one row without vector), or, with a rate, rows drawn with a chance of rate times their cost."""

    def run(batches: Batches) -> Batches:
        cost = 0.0
        for batch in batches:
            units = unpack(batch.column("unit"), size)
            if not len(units):
                continue
            away = np.maximum(0, 2 - 2 * _nearest(units, centres, 1)[1].astype(float))
            cost += away.sum()
            if rate:
                drawn = _chance(batch.column("id").to_numpy(), seed) < rate * away
                yield pa.record_batch([pa.array(np.zeros(drawn.sum())), batch.column("unit").filter(pa.array(drawn))], names=["cost", "unit"])
        if not rate:
            yield pa.record_batch([pa.array([cost]), pa.array([None], pa.binary())], names=["cost", "unit"])

    return run


def _sums(size: int, centres: np.ndarray) -> Callable[[Batches], Batches]:
    """A partition's sum and number of the vectors nearest each centre."""

    def run(batches: Batches) -> Batches:
        total, number = np.zeros((len(centres), size)), np.zeros(len(centres), np.int64)
        for batch in batches:
            units = unpack(batch.column("unit"), size)
            if len(units):
                home = _nearest(units, centres, 1)[0][:, 0]
                order = np.argsort(home, kind="stable")
                heads = np.flatnonzero(np.r_[True, home[order][1:] != home[order][:-1]])
                total[home[order][heads]] += np.add.reduceat(units[order], heads, 0)
                number += np.bincount(home, minlength=len(centres))
        used = np.flatnonzero(number)
        yield pa.record_batch([pa.array(used), pa.array(number[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cell", "n", "total"])

    return run


def _added(size: int) -> Callable[[int, pa.Table], pa.RecordBatch]:
    def solve(key: int, rows: pa.Table) -> pa.RecordBatch:
        total = rows.column("total").combine_chunks().flatten().to_numpy().reshape(-1, size).sum(0)
        return pa.record_batch([pa.array([key]), pa.array([int(rows.column("n").to_numpy().sum())]), pa.array([total], pa.list_(pa.float64()))], names=["cell", "n", "total"])

    return solve


def centres_of(units: DataFrame, k: int, size: int) -> np.ndarray:
    """At most about ``k`` centres; only candidates and sums of that number reach the driver. They don't depend on the partitioning but for rounding.

    Seeding draws about k vectors in each of a few rounds, all partitions at once, with chances in proportion to the
    squared distance from the vectors drawn so far; the candidates are weighted by the vectors nearest to them and
    thinned to k by the same rule on the driver. Then all vectors move the centres a few times.
    """
    first = units.orderBy(F.xxhash64("id"), "id").limit(1).toArrow()
    if not first.num_rows:
        return np.zeros((0, size))
    centres = unpack(first.column("unit"), size)
    for r in range(SEED_ROUNDS):
        cost = units.mapInArrow(_oversampled(size, centres, 0.0, 0), "cost double, unit binary").agg(F.sum("cost")).first()[0] or 0.0
        if cost < 1e-9:
            break
        drawn = units.mapInArrow(_oversampled(size, centres, k / cost, SEED + r), "cost double, unit binary").toArrow()
        centres = np.concatenate([centres, unpack(drawn.column("unit").combine_chunks().sort(), size)])
    schema = "cell long, n long, total array<double>"
    for move in range(MOVES + 1):
        parts = units.mapInArrow(_sums(size, centres), schema).repartition("cell").sortWithinPartitions("cell")
        found = parts.mapInArrow(grouped(_added(size), "cell"), schema).toArrow()
        cells, weight = found.column("cell").to_numpy(), found.column("n").to_numpy().astype(float)
        order = np.argsort(cells)
        total = found.column("total").combine_chunks().flatten().to_numpy().reshape(-1, size)[order]
        if move == 0 and len(cells) > k:
            centres, weight = centres[cells[order]], weight[order]
            centres = centres[_thinned(centres, weight, k)]
            continue
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-300), centres[cells[order]])  # vectors that cancel each other leave the centre where it is
    return centres


def _thinned(points: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Weighted seeding of k of the candidates."""
    rng = np.random.default_rng(SEED)
    chosen = [int(weight.argmax())]
    away = np.maximum(0, 2 - 2 * points @ points[chosen[0]])
    while len(chosen) < k:
        chance = weight * away
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=chance / chance.sum())))
        away = np.minimum(away, np.maximum(0, 2 - 2 * points @ points[chosen[-1]]))
    return np.array(chosen)


def _entered(size: int, centres: np.ndarray, with_unit: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _nearest(unpack(batch.column("unit"), size), centres, ENTERED)[0]
            if not with_unit:
                yield pa.record_batch([pa.array(cells.ravel())], names=["cell"])
                continue
            for c in range(cells.shape[1]):
                yield pa.record_batch([pa.array(np.ascontiguousarray(cells[:, c])), batch.column("id"), batch.column("unit")], names=["cell", "id", "unit"])

    return run


def linked(units: np.ndarray, least: float, side: np.ndarray | None = None) -> np.ndarray:
    """The first row of each row's chain of links of cosine ``least`` or more; with ``side``, only rows of different sides need be compared.

    Rows within half the angle of a leader are within the angle of each other, so tight groups are joined without comparing
    their pairs; blocks whose rows all have one label already are skipped.
    """
    n = len(units)
    label = np.arange(n)
    small = units.astype(np.float32)
    near = np.float32(((1 + least) / 2) ** 0.5 + 1e-5)
    for lead in range(0, n, max(1, n // LEADERS)):
        if label[lead] == lead and (group := (label == np.arange(n)) & (small @ small[lead] >= near)).sum() > 1:
            label[group] = np.flatnonzero(group)[0]
    order = np.lexsort((label, side)) if side is not None else np.argsort(label, kind="stable")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    label = back[label[order]]
    first = np.full(n, n)
    np.minimum.at(first, label, np.arange(n))
    label = first[label]
    units, small, side = units[order], small[order], None if side is None else side[order]
    one = lambda x, a, b: x[a] == x[min(a + BLOCK, n) - 1] == x[b] == x[min(b + BLOCK, n) - 1]
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            if side is not None and one(side, a, b):  # sides ascend
                continue
            both = label[a : a + BLOCK], label[b : b + BLOCK]
            if both[0].min() == both[0].max() == both[1].min() == both[1].max():
                continue
            _join_block(units, small, label, a, b, least)
    # the least row of each label, in the order given
    least_row = np.full(n, n)
    np.minimum.at(least_row, label, order)
    return least_row[label][back]


def _join_block(units: np.ndarray, small: np.ndarray, label: np.ndarray, a: int, b: int, least: float) -> None:
    s = small[a : a + BLOCK] @ small[b : b + BLOCK].T
    i, j = np.nonzero(s >= np.float32(least - 1e-5))
    i, j, s = i + a, j + b, s[i, j]
    keep = (i < j) & (label[i] != label[j])
    i, j, s = i[keep], j[keep], s[keep]
    close = np.flatnonzero(np.abs(s - least) < 2e-5)  # float32 can't tell
    if len(close):
        bad = close[np.einsum("ij,ij->i", units[i[close]], units[j[close]]) < least]
        i, j = np.delete(i, bad), np.delete(j, bad)
    while len(i):
        x, y = label[i], label[j]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]
        on = label[i] != label[j]
        i, j = i[on], j[on]


def _linked_cell(size: int, least: float) -> Callable[[Batches], Batches]:
    def solve(_: int, rows: pa.Table) -> pa.RecordBatch:
        ids, first = np.unique(rows.column("id").to_numpy(), return_index=True)
        side = rows.column("side").to_numpy()[first]
        root = linked(unpack(rows.column("unit").combine_chunks().take(pa.array(first)), size), least, side if side.min() != side.max() else None)
        return pa.record_batch([pa.array(ids), pa.array(ids[root])], names=["a", "b"])

    return grouped(solve, "task")


def _in_cells(units: DataFrame, centres: np.ndarray, size: int, cell_rows: int) -> DataFrame:
    counts = units.mapInArrow(_entered(size, centres, False), "cell long").groupBy("cell").count()
    entered = units.mapInArrow(_entered(size, centres, True), "cell long, id long, unit binary")
    return pair_tasks(entered, counts, "cell", cell_rows)


def _cluster_sum(size: int) -> Callable[[int, pa.Table], pa.RecordBatch]:
    def solve(key: int, rows: pa.Table) -> pa.RecordBatch:
        weight = rows.column("n").to_numpy()
        total = (unpack(rows.column("unit"), size) * weight[:, None]).sum(0)
        return pa.record_batch([pa.array([rows.column("root")[0].as_py()]), pa.array([total], pa.list_(pa.float64()))], names=["root", "total"])

    return grouped(solve, "group")


def _closeness(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                mean = batch.column("total").flatten().to_numpy().reshape(-1, size)
                close = np.einsum("ij,ij->i", mean, unpack(batch.column("unit"), size)) / np.maximum(np.linalg.norm(mean, axis=1), 1e-300)
                yield pa.record_batch([batch.column("root"), batch.column("id"), pa.array(close)], names=["root", "id", "cosine"])

    return run


def similarity_clusters(df: DataFrame, key: str, vector: str, least: float = 0.8, size: int = 64, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Clusters of vectors chained by cosines of ``least`` or more.

    First result ``id, root, n``: every usable vector with the smallest id and the number of members of its cluster.
    Second ``root, id, cosine``: of clusters of three or more, the member nearest the mean of the members' unit vectors
    (ties: smaller id). Rows with a null id, a null vector or element, another size, NaN or only zeros are left out; a
    repeated id counts once; an empty table gives no rows; other columns are ignored.

    About sqrt(n) k-means cells; each vector enters the cells of its nearest centres, the links in a cell are found
    exactly, and components join the cells. A link is lost only if its ends share none of their cells and no other
    chain joins them (README has the measured figures). Copies enter as one vector and count as many. The driver gets the
    centres and the candidates for them, nothing else; a cell above ``cell_rows`` is cut into slices that all meet.
    """
    everything = packed_units(vector_rows(df, key, vector, size), size)
    copies = exact_copies(everything)
    any_copies = not copies.isEmpty()
    units = cut(without_copies(everything, copies) if any_copies else everything)
    centres = centres_of(units, max(1, round(units.count() ** 0.5)), size)
    if not len(centres):
        roots = units.select("id", F.col("id").alias("root"))
    else:
        tasks = _in_cells(units, centres, size, cell_rows).repartition("task").sortWithinPartitions("task")
        found = cut(tasks.mapInArrow(_linked_cell(size, least), "a long, b long").distinct())
        nearest = found.groupBy("a").agg(F.min("b").alias("root"))
        joined = components(found.join(nearest, "a").filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b")))
        tops = joined.select(F.col("id").alias("root"), F.col("root").alias("top"))
        counted = nearest.groupBy("root").agg(F.count("*").alias("n")).join(tops, "root")
        roots = joined_spread(nearest, counted, ["root"], "a", "left").select(F.col("a").alias("id"), F.coalesce("top", "root").alias("root"))
    members = roots.withColumn("weight", F.lit(1).cast("long"))
    if any_copies:
        copied = copies.groupBy("rep").agg((F.count("*") + 1).alias("weight"))
        members = roots.join(copied.withColumnRenamed("rep", "id"), "id", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))
    members = cut(members)
    sizes = cut(members.groupBy("root").agg(F.sum("weight").alias("n")))
    with_size = cut(joined_spread(members, sizes, ["root"], "id"))
    everyone = with_size.select("id", "root", "n")
    if any_copies:
        of = everyone.join(copied.select(F.col("rep").alias("id"), "weight"), "id").select(F.col("id").alias("rep"), "root", F.col("n").alias("members"), F.col("weight").alias("n"))
        more = joined_spread(copies, of, ["rep"], "id").select("id", "root", F.col("members").alias("n"))
        everyone = everyone.unionByName(more)
    with_unit = units.dropDuplicates(["id"]).join(with_size.filter("n >= 3"), "id")
    sliced = with_unit.withColumn("group", F.xxhash64("root", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SLICE_ROWS))))
    sums = sliced.select("group", "root", "unit", F.col("weight").alias("n")).repartition("group").sortWithinPartitions("group", "root")
    means = sums.mapInArrow(_cluster_sum(size), "root long, total array<double>").groupBy("root").agg(F.collect_list("total").alias("parts"))
    added = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.get(p, d)))
    means = means.select("root", F.when(F.size("parts") == 1, F.element_at("parts", 1)).otherwise(added).alias("total")).join(sizes, "root")
    close = joined_spread(with_unit.select("root", "id", "unit"), means, ["root"], "id").select("root", "id", "unit", "total").mapInArrow(_closeness(size), "root long, id long, cosine double")
    typical = close.groupBy("root").agg(F.max(F.struct("cosine", (-F.col("id")).alias("minus"))).alias("x")).select("root", (-F.col("x.minus")).alias("id"), "x.cosine")
    return everyone.select("id", "root", "n"), typical
