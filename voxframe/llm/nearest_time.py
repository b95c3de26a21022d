"""Pairing of records with the nearest record in time, by x-fast tries over bit prefixes of the timestamps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ticks of one trie, a power of two; an entity is cut into stretches of this length.
STRETCH_BITS = 18
#: Odd 64-bit multiplier of the hash tables (a fixed value).
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PrefixTable:
    """Open-addressing hash table from bit prefixes to the first and last leaf below them."""

    def __init__(self, prefixes: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(2 * len(prefixes) + 2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.prefixes, self.first, self.last = prefixes, first, last
        todo, at = np.arange(len(prefixes)), self._home(prefixes)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, prefixes: np.ndarray) -> np.ndarray:
        return ((prefixes.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, prefixes: np.ndarray) -> np.ndarray:
        """Row of each prefix, or -1."""
        found = np.full(len(prefixes), -1, np.int64)
        todo, at = np.arange(len(prefixes)), self._home(prefixes)
        while len(todo):
            row = self.slots[at]
            hit = (row >= 0) & (self.prefixes[np.maximum(row, 0)] == prefixes[todo])
            found[todo[hit]] = row[hit]
            on = (row >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return found


def trie_neighbours(keys: np.ndarray, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``keys`` of the greatest key <= and the smallest key > each asked value (-1: none).

    ``keys`` ascend without repeats. All values with the same bits above ``bits`` form one trie, so the keys of many
    entities may stand in one call. The level of the lowest ancestor that exists is found by binary search over the
    prefix length.
    """
    none = np.full(len(asked), -1, np.int64)
    if not len(keys) or not len(asked):
        return none, none.copy()
    tables, first, last, prefixes = [], np.arange(len(keys)), np.arange(len(keys)), keys
    for level in range(bits + 1):
        if level:
            up = prefixes >> 1
            head = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            first, last = first[head], last[np.r_[head[1:] - 1, len(up) - 1]]
            prefixes = up[head]
        tables.append(PrefixTable(prefixes, first, last))
    low, high, node = np.zeros(len(asked), np.int64), np.full(len(asked), bits + 1, np.int64), none.copy()
    while (on := low < high).any():
        middle = (low + high) // 2
        for level in np.unique(middle[on]):
            at = np.flatnonzero(on & (middle == level))
            row = tables[level].find(asked[at] >> level)
            node[at[row >= 0]] = row[row >= 0]
            high[at[row >= 0]] = level
            low[at[row < 0]] = level + 1
    below, above = none.copy(), none.copy()
    for level in np.unique(low[low <= bits]):
        at = np.flatnonzero(low == level)
        table, row = tables[level], node[at]
        if level == 0:
            below[at] = table.first[row]
            following = table.first[row] + 1
        else:
            right = ((asked[at] >> (level - 1)) & 1) == 1  # the missing child is the right one: all keys here are smaller
            below[at] = np.where(right, table.last[row], table.first[row] - 1)
            following = below[at] + 1
        above[at] = np.where(following < len(keys), following, -1)
    for side in (below, above):
        other = (side >= 0) & ((keys[np.maximum(side, 0)] >> bits) != (asked >> bits))
        side[other] = -1
    return below, above


def _pair(limit: int, bits: int):
    """Pairs asked times (kind 1) with event times (kind 0) of one ``entity, stretch``, whole stretches at a time."""
    out = pa.schema([("entity", pa.string()), ("asked", pa.int64()), ("tick", pa.int64()), ("rank_a", pa.int64()), ("rank_b", pa.int64())])

    def solve(t: pa.Table) -> pa.RecordBatch:
        entity = t.column("entity").combine_chunks().dictionary_encode()
        codes, stretch = entity.indices.to_numpy(zero_copy_only=False).astype(np.int64), t.column("stretch").to_numpy()
        kind, tick = t.column("kind").to_numpy(), t.column("tick").to_numpy()
        change = np.r_[False, (codes[1:] != codes[:-1]) | (stretch[1:] != stretch[:-1])]
        group = np.cumsum(change)
        span = bits + 1
        local = (group << span) | (tick - (stretch << bits) + (1 << (bits - 1)))
        events, asks = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        below, above = trie_neighbours(local[events], local[asks], span)
        at = tick[asks]
        near = lambda side: np.where(side >= 0, np.abs(tick[events[np.maximum(side, 0)]] - at), limit + 1) if len(events) else np.full(len(at), limit + 1)
        before, after = near(below), near(above)
        choice = np.where(before <= after, below, above)
        good = np.minimum(before, after) <= limit
        rows, asks = events[choice[good]], asks[good]
        names = pa.DictionaryArray.from_arrays(pa.array(codes[asks]), entity.dictionary).cast(pa.string())
        return pa.record_batch([names, pa.array(tick[asks]), pa.array(tick[rows]), t.column("rank_a").combine_chunks().take(pa.array(rows)), t.column("rank_b").combine_chunks().take(pa.array(rows))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            e, s = batch.column("entity"), batch.column("stretch").to_numpy()
            new = np.flatnonzero((s != s[-1]) | ~pa.compute.equal(e, e[-1]).to_numpy(zero_copy_only=False))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last stretch of the batch may go on
            if not cut and held:
                last = held[-1]
                if last.column("stretch")[-1].as_py() != s[0] or last.column("entity")[-1].as_py() != e[0].as_py():
                    yield solve(pa.Table.from_batches(held))
                    held = []
            elif cut:
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def nearest_in_time(asked: DataFrame, events: DataFrame, limit: int, bits: int = STRETCH_BITS) -> DataFrame:
    """The nearest event of the same entity for every asked time, at most ``limit`` ticks away.

    ``asked`` has ``entity`` (string) and ``tick`` (long), ``events`` also ``rank_a`` and ``rank_b`` (long). The result
    has one row ``entity, asked, tick, rank_a, rank_b`` for each distinct asked time that has such an event. Ties: the
    earlier event, then the smaller (rank_a, rank_b). Rows with a null entity or tick are left out; repeated rows change
    nothing; an empty table gives no rows.

    An entity is cut into stretches of 2^``bits`` ticks, each a trie of its own; events within ``limit`` of a border
    stand in both stretches. As only the first event of a tick counts, a stretch holds at most as many rows as it has
    ticks, however many rows an entity has. The limit must be below a quarter of a stretch.
    """
    if not 0 <= limit < 1 << (bits - 2):
        raise ValueError("the limit must be below a quarter of a stretch")
    here = lambda c: F.shiftright(c, bits)
    stretches = F.array_distinct(F.array(here(F.col("tick") - limit), here(F.col("tick")), here(F.col("tick") + limit)))
    e = events.filter("entity is not null and tick is not null").select("entity", F.explode(stretches).alias("stretch"), "tick", F.struct(F.col("rank_a").cast("long").alias("rank_a"), F.col("rank_b").cast("long").alias("rank_b")).alias("rank"), F.lit(0).alias("kind"))
    q = asked.filter("entity is not null and tick is not null").select("entity", here(F.col("tick")).alias("stretch"), "tick", F.lit(None).cast("struct<rank_a:bigint,rank_b:bigint>").alias("rank"), F.lit(1).alias("kind"))
    both = e.unionByName(q).repartition("entity", "stretch").groupBy("entity", "stretch", "kind", "tick").agg(F.min("rank").alias("rank"))
    rows = both.select("entity", "stretch", "kind", "tick", "rank.rank_a", "rank.rank_b").sortWithinPartitions("entity", "stretch", "kind", "tick")
    return rows.mapInArrow(_pair(limit, bits), "entity string, asked long, tick long, rank_a long, rank_b long")
