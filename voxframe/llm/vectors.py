"""Unit vectors as compact fixed-point bytes, tables of exact copies, and groups of rows that come in sorted batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.joins import joined_spread
from voxframe.session import cut

#: Fixed point of 20 bits a value: a cosine of two packed unit vectors is right to about 3e-6.
SCALE = float(1 << 19)


def pack(units: np.ndarray) -> pa.Array:
    """Rows of unit vectors of even size as binary, five bytes for two values."""
    if not len(units):
        return pa.array([], pa.binary())
    whole = (np.clip(np.rint(units * SCALE), -SCALE, SCALE - 1).astype(np.int64) & 0xFFFFF).reshape(len(units), -1, 2)
    both = whole[:, :, 0] | (whole[:, :, 1] << 20)
    data = np.ascontiguousarray(both.astype("<i8").view(np.uint8).reshape(len(units), -1, 8)[:, :, :5]).reshape(len(units), -1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1]), len(units), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpack(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The float64 vectors of a packed column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, size))
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size // 2, 5)
    wide = np.zeros((len(column), size // 2, 8), np.uint8)
    wide[:, :, :5] = data
    both = wide.view("<i8")[:, :, 0]
    signed = np.stack([both & 0xFFFFF, both >> 20], 2).reshape(len(column), size)
    return np.where(signed >= 1 << 19, signed - (1 << 20), signed) / SCALE


def usable(batch: pa.RecordBatch, size: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit vectors of the rows whose vector has ``size`` finite values that aren't all zero."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("vector")), size), False))
    flat = pc.fill_null(batch.column("vector").flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
    norm = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return batch.column("id").filter(pa.array(good)), flat[good] / norm[good, None]


def vector_rows(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``id, vector`` of the rows with an id and ``size`` values that aren't all zero."""
    v = F.col(vector)
    return df.filter(F.col(key).isNotNull() & (F.size(v) == size) & ((F.array_max(v) != 0) | (F.array_min(v) != 0))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))


def packed_units(rows: DataFrame, size: int) -> DataFrame:
    """``id, unit``: packed unit vectors of the usable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = usable(batch, size)
            yield pa.record_batch([ids, pack(units)], names=["id", "unit"])

    return rows.mapInArrow(run, "id long, unit binary")


def exact_copies(units: DataFrame) -> DataFrame:
    """``id, rep``: every id whose packed unit vector also stands under a smaller id, with the smallest such id. Written to the shared folder.

    As packed vectors are compared, vectors of another length or encoding are copies too. Only hashes of 128 bits and ids are
    shuffled; a vector that is a third of all rows is combined before the shuffle.
    """
    hashed = units.select("id", F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), "unit").alias("h2"))
    least = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("most"), F.count("*").alias("n")).filter("rep < most")
    return cut(joined_spread(hashed, least, ["h1", "h2"], "id").filter("id > rep").groupBy("id").agg(F.min("rep").alias("rep")))


def without_copies(units: DataFrame, copies: DataFrame) -> DataFrame:
    return units.join(copies.select("id"), "id", "left_anti")


def pair_tasks(placed: DataFrame, counts: DataFrame, group: str, limit: int) -> DataFrame:
    """``task, side, id, unit``: rows of a group that meet in one task.

    A group of up to ``limit`` rows (``counts`` has ``group, count``) is one task; a larger one is cut into slices, and each
    pair of slices is a task, so all its rows meet and none is left out. A slice meets itself in the task where ``side`` is 0
    throughout; elsewhere only rows of different sides are to be compared.
    """
    hot = counts.filter(F.col("count") > limit).select(group, F.ceil(F.col("count") / limit).cast("int").alias("__slices"))
    # at most rows / limit groups are hot
    sliced = placed.join(F.broadcast(hot), group, "left").withColumn("__slices", F.coalesce("__slices", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("__slices")).cast("int")
    tasks = sliced.withColumn("__own", own).withColumn("__partner", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)))
    low, high = F.least("__own", "__partner"), F.greatest("__own", "__partner")
    task = F.when(F.col("__slices") == 1, F.xxhash64(group)).otherwise(F.xxhash64(group, low, high))
    return tasks.select(task.alias("task"), F.when(low == high, 0).otherwise(F.col("__own")).alias("side"), "id", "unit")


def grouped(solve: Callable[[int, pa.Table], pa.RecordBatch | None], key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``solve`` with each whole group of rows that come sorted by the long ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                if held and keys[a] != current:
                    if (found := solve(current, pa.Table.from_batches(held))) is not None:
                        yield found
                    held = []
                current = keys[a]
                held.append(batch.slice(a, b - a))
        if held and (found := solve(current, pa.Table.from_batches(held))) is not None:
            yield found

    return run
