"""Collapsing of runs of near-identical consecutive events, by pruned dynamic programming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.intervals import with_latest_end
from voxframe.session import cut

#: Time chunks that split one entity over several tasks.
CHUNK_MS = 1_800_000
#: Cost of a boundary; a run with a dissimilar or distant neighbour costs more than that.
BOUNDARY_COST = 1.0
#: Letters that Unicode decomposition leaves alone, with what they fold to (fixed values).
FOLDED_LETTERS = {"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d"}
#: Accented small letters of the languages at hand and their bases, position by position (fixed values).
ACCENTED = "àáâãäåāăąçćčèéêëēĕėęěìíîïĩīĭįñńňòóôõöōŏőùúûüũūŭůűýÿžźżšśřťďľĺğ"
BASES = "aaaaaaaaaccceeeeeeeeeiiiiiiiinnnoooooooouuuuuuuuuyyzzzssrtdllg"


def folded_label(label: Column | str) -> Column:
    """A label without case, accents, spaces and punctuation; null if no letter or digit is left.

    Precomposed and combining accents fold to the same letters.
    """
    c = F.lower(F.col(label) if isinstance(label, str) else label)
    for letter, plain in FOLDED_LETTERS.items():
        c = F.replace(c, F.lit(letter), F.lit(plain))
    c = F.regexp_replace(F.translate(c, ACCENTED, BASES), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(c) > 0, c)


@lru_cache(maxsize=100_000)
def label_distance(a: str, b: str) -> float:
    """Edits from one label to the other as a share of the longer one."""
    if a == b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] / max(len(a), len(b))


def certain_breaks(starts: np.ndarray, ends: np.ndarray, groups: np.ndarray, max_gap: int) -> np.ndarray:
    """Which events begin a run in every optimal segmentation, whatever their labels: the first of a group, and one that starts more than ``max_gap`` after all ends before it."""
    change = np.r_[True, groups[1:] != groups[:-1]]
    block = np.cumsum(change)
    # the running maximum starts anew in each block: blocks are lifted above one another
    lift = block * (np.int64(ends.max(initial=0)) - np.int64(ends.min(initial=0)) + 1)
    latest = np.maximum.accumulate(ends + lift) - lift
    return change | np.r_[True, starts[1:] - latest[:-1] > max_gap]


def _optimal(starts: list[int], ends: list[int], labels: list[str], max_gap: int, alike: float, penalty: float) -> list[int]:
    """First events of the runs of the cheapest segmentation of one stretch of events.

    A candidate is a start of the run at hand: its first event, the cost before it, the cost of late starts, the latest end, how
    often each label stands in the run, and what each label would cost as the run's own.
    """
    if alike:
        far = 1 + penalty
        pair = lambda a, b: min(far, label_distance(a, b) / alike * penalty) if label_distance(a, b) <= alike else far
    else:  # a run never goes on after another label: an event within a run costs more than the two boundaries that it saves
        far = 1 + 2 * penalty
        pair = lambda a, b: 0.0 if a == b else far
    best, origin = [0.0], []
    candidates: list[list] = []
    for i, (start, end, label) in enumerate(zip(starts, ends, labels, strict=True)):
        for c in candidates:
            c[2] += far * (start - c[3] > max_gap)
            c[3] = max(c[3], end)
            if label not in c[5]:
                c[5][label] = sum(n * pair(x, label) for x, n in c[4].items())
            c[4][label] = c[4].get(label, 0) + 1
            for own in c[5]:
                c[5][own] += pair(label, own)
        candidates.append([i, best[i] + penalty, 0.0, end, {label: 1}, {label: 0.0}])
        costs = [c[1] + c[2] + min(c[5].values()) for c in candidates]
        least = min(costs)
        origin.append(candidates[costs.index(least)][0])
        best.append(least)
        # costs only grow, and a new run after this event costs ``least + penalty``
        candidates = [c for c, x in zip(candidates, costs, strict=True) if x < least + penalty]
    firsts, i = [], len(starts) - 1
    while i >= 0:
        firsts.append(origin[i])
        i = origin[i] - 1
    return firsts[::-1]


def segment(starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, groups: np.ndarray, max_gap: int, alike: float = 0.0, penalty: float = BOUNDARY_COST) -> np.ndarray:
    """Number of the run of each event, by optimal segmentation.

    The cost of a segmentation is ``penalty`` for each run plus the dissimilarity within the runs, pruned dynamic programming
    finds the cheapest one. An event costs as much of a boundary as the distance of its label from its run's own label (the
    one that costs least) has of ``alike``; beyond ``alike``, and if it starts more than ``max_gap`` after the latest end so
    far, it costs more than a boundary. With ``alike`` 0 an event with another label costs more than the two boundaries that it
    would save, so the cheapest runs are those of equal labels. Pauses part the events into stretches, for each of which the program runs.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    first = certain_breaks(starts, ends, groups, max_gap)
    at = np.r_[np.flatnonzero(first), len(starts)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            first[a + np.array(_optimal(starts[a:b].tolist(), ends[a:b].tolist(), labels[a:b].tolist(), max_gap, alike, penalty))] = True
    return np.cumsum(first) - 1


def _own_label(labels: pd.Series, number: np.ndarray) -> pd.Series:
    """The most frequent label of each run (ties: the smallest)."""
    counts = pd.DataFrame({"run": number, "label": labels}).groupby(["run", "label"], sort=True).size()
    return counts.reset_index(name="n").sort_values(["run", "n", "label"], ascending=[True, False, True], kind="stable").drop_duplicates("run").set_index("run")["label"]


def _collapse(sums: list[str], max_gap: int, alike: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs of rows that come ordered within each ``__group``; rows after the last certain boundary of a batch wait for the next batch."""
    keep = ["__group", "__label", "__s", "__e", "__first", "__last", "n_rows", *sums]
    how = {"__group": "first", "__label": "first", "__s": "first", "__e": "max", "__first": "first", "__last": "last", "n_rows": "sum"} | dict.fromkeys(sums, "sum")

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        number = segment(rows["__s"].to_numpy(), rows["__e"].to_numpy(), rows["__label"].to_numpy(object), pd.factorize(rows["__group"])[0], max_gap, alike)
        found = rows.groupby(number, sort=True).agg(how)[keep]
        return found.assign(__label=_own_label(rows["__label"], number)) if alike else found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            breaks = np.flatnonzero(certain_breaks(rows["__s"].to_numpy(), rows["__e"].to_numpy(), pd.factorize(rows["__group"])[0], max_gap))
            if breaks[-1]:
                yield runs(rows.iloc[: breaks[-1]])
            held = rows.iloc[breaks[-1] :].reset_index(drop=True)
        if held is not None:
            yield runs(held)

    return run


def collapse_runs(
    df: DataFrame, entity: str, start: str, end: str, row_key: str, label: str, max_gap: int = 2000, sums: tuple[str, ...] = (), chunk_ms: int = CHUNK_MS, alike: float = 0.0
) -> DataFrame:
    """Runs of like consecutive events: ``entity, label, first_key, last_key, start_ms, end_ms, n_rows`` and ``sums``.

    Events of an entity are ordered by (``start``, ``row_key``); they are segmented by ``segment``. With ``alike`` 0 an event
    continues the run if its ``label`` equals that of the event before and it starts at most ``max_gap`` after the latest end
    within the run; above 0 labels may differ by edits of up to that share, and the run's label is its most frequent one. Rows
    with a null entity, label, start or key are left out; a null end counts as the start. Of rows with the same entity and
    key one counts. Ties of start are ordered by key. An empty table gives no rows; other columns are ignored.

    The program runs over chunks of time, so an entity spreads over many tasks. Runs beside a border of chunks are then
    joined, as far as their labels are alike, by the latest ends that earlier chunks carry over, chunk by chunk again; so a
    session of one label isn't one task either.
    """
    rows = df.filter(F.col(entity).isNotNull() & F.col(label).isNotNull() & F.col(start).isNotNull() & F.col(row_key).isNotNull())
    rows = rows.select(
        F.col(entity).alias("__entity"), F.col(label).alias("__label"), F.col(start).alias("__s"), F.coalesce(end, start).alias("__e"), F.col(row_key).cast("long").alias("__key"), *(F.col(c).cast("long").alias(c) for c in sums)
    ).withColumn("__part", F.floor(F.col("__s") / chunk_ms))
    # copies of a row have the same start, hence the same chunk
    once = rows.repartition("__entity", "__part").dropDuplicates(["__entity", "__part", "__key"])
    packed = once.select(F.concat_ws("\x01", "__part", "__entity").alias("__group"), "__label", "__s", "__e", F.col("__key").alias("__first"), F.col("__key").alias("__last"), F.lit(1).cast("long").alias("n_rows"), *sums)
    more = "".join(f", {c} long" for c in sums)
    schema = f"__group string, __label string, __s long, __e long, __first long, __last long, n_rows long{more}"
    local = packed.sortWithinPartitions("__group", "__s", "__first").mapInPandas(_collapse(list(sums), max_gap, alike), schema)
    # the runs of the chunks are read several times below
    local = cut(local.select(F.substring_index("__group", "\x01", 1).cast("long").alias("__part"), F.expr("substring(__group, instr(__group, '\x01') + 1)").alias("__entity"), *[c for c in local.columns if c != "__group"]))
    in_part = Window.partitionBy("__entity", "__part").orderBy("__s", "__first")
    change = (~F.col("__label").eqNullSafe(F.lag("__label").over(in_part))).cast("long")
    blocks = local.withColumn("__block", F.sum(change).over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("__blocks", F.max("__block").over(Window.partitionBy("__entity", "__part")))
    # a chunk of several blocks ends one chain of border runs and begins the next; a chunk of another label does so too
    ends = blocks.groupBy("__entity", "__part").agg((F.max("__block") > 1).cast("long").alias("__many"), F.min_by("__label", "__block").alias("__head"), F.max_by("__label", "__block").alias("__tail"))
    by_part = Window.partitionBy("__entity").orderBy("__part")
    tail = F.lag("__tail").over(by_part)
    like = F.coalesce(F.levenshtein("__head", tail) <= F.greatest(F.length("__head"), F.length(tail)) * alike, F.lit(False)) if alike else F.col("__head").eqNullSafe(tail)
    parts = ends.withColumn("__other", (~like).cast("long"))
    chain = parts.select("__entity", "__part", (F.sum(F.col("__many") + F.col("__other")).over(by_part) - F.col("__many")).alias("__chain"))
    inner = blocks.filter((F.col("__block") > 1) & (F.col("__block") < F.col("__blocks")))
    border = blocks.filter((F.col("__block") == 1) | (F.col("__block") == F.col("__blocks"))).join(chain, ["__entity", "__part"])
    linked = border.withColumn("__chain", F.col("__chain") + (F.col("__block") > 1).cast("long")).drop("__part", "__block", "__blocks")
    keys = ["__entity", "__chain"]
    late = with_latest_end(linked, keys, ["__s", "__first"], "__s", "__e", "__latest", chunk_ms)
    opens = F.col("__latest").isNull() | (F.col("__s") - F.col("__latest") > max_gap)
    marked = cut(late.withColumn("__open", F.when(opens, F.col("__s"))))
    carried = marked.groupBy(*keys, "__chunk").agg(F.max("__open").alias("__o"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*keys, "__chunk", F.max("__o").over(before).alias("__carried"))
    own = F.max("__open").over(Window.partitionBy(*keys, "__chunk").orderBy("__s", "__first").rowsBetween(Window.unboundedPreceding, 0))
    placed = marked.join(carried, [*keys, "__chunk"]).withColumn("__run", F.coalesce(own, "__carried"))
    order = F.struct("__s", "__first")
    stitched = placed.groupBy(*keys, "__run").agg(
        F.min_by("__label", order).alias("__label"), F.min_by("__first", order).alias("__first"), F.max_by("__last", order).alias("__last"), F.min("__s").alias("__s"), F.max("__e").alias("__e"), F.sum("n_rows").alias("n_rows"), *[F.sum(c).alias(c) for c in sums]
    )
    columns = [F.col("__entity").alias(entity), F.col("__label").alias("label"), F.col("__first").alias("first_key"), F.col("__last").alias("last_key"), F.col("__s").alias("start_ms"), F.col("__e").alias("end_ms"), "n_rows", *sums]
    return inner.select(*columns).unionByName(stitched.select(*columns))
