"""Filling of fixed-capacity containers with whole items, balanced by cost."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.session import cut

CAPACITY = 2048
#: Items packed by one call; the table is cut into groups of about so many items.
GROUP_ITEMS = 5_000
#: Containers tried in turn for an item that has found no room.
TRIED = 40
#: Cost of an item of n tokens: n + n * n / QUADRATIC_FROM (attention outweighs the rest from there on).
QUADRATIC_FROM = 4096


def fill(sizes: np.ndarray, capacity: int, quadratic_from: int = QUADRATIC_FROM) -> np.ndarray:
    """Container of each item: in descending size, the open container of lowest cost that has room.

    As many containers are open at first as the total size needs at least; one is added when none has room. Balanced to the
    end, all keep a little room that no item fits; ``gather`` then exchanges items so that the added containers become empty.
    """
    order = np.argsort(-sizes, kind="stable")
    least = max(1, -(-int(sizes.sum()) // capacity))
    room, cost = np.full(least, capacity, np.int64), np.zeros(least)
    place = np.empty(len(sizes), np.int64)
    for i in order:
        n = int(sizes[i])
        fits = np.flatnonzero(room >= n)
        if len(fits):
            k = fits[np.argmin(cost[fits])]
        else:
            k = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[k] -= n
        cost[k] += n + n * n / quadratic_from
        place[i] = k
    return gather(sizes, place, room, least, capacity) if len(room) > least else place


def gather(sizes: np.ndarray, place: np.ndarray, room: np.ndarray, least: int, capacity: int) -> np.ndarray:
    """Moves the items of the containers beyond the first ``least`` into these, by exchanges that bring their room together.

    For an item, a container with much room exchanges items for smaller ones of others, which have the room for the
    difference, until the item fits. The containers with most room are tried in turn; an item for which all fail stays.
    Containers are numbered anew.
    """
    size, room = sizes.tolist(), room.tolist()  # plain numbers: the containers hold a few items each
    inside: list[list[int]] = [[] for _ in room]
    for i, k in enumerate(place.tolist()):
        inside[k].append(i)
    for extra in range(least, len(room)):
        for i in sorted(inside[extra], key=lambda j: (-size[j], j)):
            n = size[i]
            by_room = sorted((k for k in range(least) if room[k] > 0), key=lambda k: -room[k])
            if sum(room[k] for k in by_room) < n:
                continue
            for to in by_room[:TRIED]:
                for other in by_room:
                    if room[to] >= n or room[other] <= 0:
                        break
                    if other == to:
                        continue
                    most, best = min(room[other], n - room[to]), (0, 0, 0)
                    for x, a in enumerate(inside[to]):
                        for y, b in enumerate(inside[other]):
                            if best[0] < size[a] - size[b] <= most:
                                best = size[a] - size[b], x, y
                    gain, x, y = best
                    if gain:
                        inside[to][x], inside[other][y] = inside[other][y], inside[to][x]
                        room[to] += gain
                        room[other] -= gain
                if room[to] >= n:
                    inside[extra].remove(i)
                    inside[to].append(i)
                    room[to] -= n
                    room[extra] += n
                    break
    # what is left over goes together
    rest = [i for own in inside[least:] for i in own]
    inside[least:] = []
    for i in sorted(rest, key=lambda j: (-size[j], j)):
        own = next((own for own in inside[least:] if sum(size[j] for j in own) + size[i] <= capacity), None)
        if own is None:
            inside.append([i])
        else:
            own.append(i)
    found = np.empty_like(place)
    for k, own in enumerate(own for own in inside if own):
        found[own] = k
    return found


def _pack(capacity: int, key: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "piece_no"], kind="stable").reset_index(drop=True)
        sizes = rows["n_tokens"].to_numpy(np.int64)
        rows["container"] = fill(sizes, capacity)
        rows["start_at"] = rows.groupby("container")["n_tokens"].cumsum() - rows["n_tokens"]
        return rows[[key, "piece_no", "first_token", "n_tokens", "__group", "container", "start_at"]]

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``key, piece_no, first_token, n_tokens, container_id, start_at``: where each item lies.

    Items with a null size or a size of zero or less take no space and have no row. Only an item longer than
    ``capacity`` is split: into full pieces, each alone in a container, and a rest that is packed like an item. Items
    are spread by a hash of their key over groups of about ``group_items``; each group is packed by itself, so the work
    and memory of a task are bounded, and at most one or two containers a group stay partly empty. ``key`` is a long
    and unique (repeated rows are packed once); ties of size are placed in the order of the key. An empty table gives
    no rows; other columns are ignored.
    """
    sized = cut(items.filter(F.col(size) > 0).groupBy(F.col(key).cast("long").alias(key)).agg(F.max(F.col(size).cast("long")).alias("__n")))
    groups = max(1, round(sized.count() / group_items))
    whole, rest = F.floor(F.col("__n") / capacity), F.col("__n") % capacity
    full = sized.filter(whole > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece_no"))
    full = full.select(key, "piece_no", (F.col("piece_no") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("f"), key, "piece_no").alias("container_id"), F.lit(0).cast("long").alias("start_at"))
    loose = sized.filter(rest > 0).select(key, whole.alias("piece_no"), (whole * capacity).alias("first_token"), rest.alias("n_tokens"), F.pmod(F.xxhash64(key), F.lit(groups)).alias("__group"))
    schema = f"{key} long, piece_no long, first_token long, n_tokens long, __group long, container long, start_at long"
    packed = loose.groupBy("__group").applyInPandas(_pack(capacity, key), schema)
    return full.unionByName(packed.select(key, "piece_no", "first_token", "n_tokens", F.concat_ws("-", F.lit("g"), "__group", "container").alias("container_id"), "start_at"))
