"""Vector arithmetic, mean vectors, and the best match of vectors among profiles."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.session import cut

#: Rows of either side that meet in one task.
BLOCK_ROWS = 20_000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """A vector of length 1, or the vector itself if it is all zero."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """``keys, mean, n``: the mean of the vectors of each key, by value positions, so a hot key is summed before the shuffle.

    Null vectors are left out; all vectors of a key have one size.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("__pos", "__x"))
    by_pos = rows.groupBy(*keys, "__pos").agg(F.avg(F.col("__x").cast("double")).alias("__x"), F.count("*").alias("n"))
    return by_pos.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__x"))), lambda x: x["__x"]).alias("mean"), F.max("n").alias("n"))


def _best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The profile with the greatest cosine for each query; all vectors of a group have one size."""
    if not len(left) or not len(right):
        return pd.DataFrame({"query": pd.Series(dtype="str"), "ord": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
    right = right.sort_values("ord")
    a, b = np.stack(left["vector"].to_numpy()).astype(float), np.stack(right["vector"].to_numpy()).astype(float)
    length = lambda m: np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    cosine = (a / length(a)) @ (b / length(b)).T
    at = cosine.argmax(1)
    return pd.DataFrame({"query": left["query"].to_numpy(), "ord": right["ord"].to_numpy()[at], "cosine": cosine[np.arange(len(at)), at]})


def best_profiles(queries: DataFrame, profiles: DataFrame, threshold: float | None = 0.6, allowed: DataFrame | None = None) -> DataFrame:
    """``query, speaker, ord, cosine``: the profile most similar to each query vector, if the cosine reaches ``threshold`` (None: always).

    ``queries`` has ``query`` (string) and ``vector``, ``profiles`` ``ord, speaker, vector``; ``allowed`` restricts the
    speakers. A query is compared with the profiles of its size; nulls and null elements are left out; ties take the
    smaller ord. Profiles (people with a voice) are a stated set that all queries are compared with: both sides are cut
    into blocks by the hash of their key, each pair of blocks is one task that returns one row per query. With up to
    ``BLOCK_ROWS`` profiles the queries aren't copied.
    """
    whole = lambda df: df.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()))
    left = whole(queries.select(F.col("query").cast("string").alias("query"), "vector"))
    right = whole(profiles if allowed is None else profiles.join(allowed.select("speaker").distinct(), "speaker", "left_semi"))
    n_left, n_right = (max(1, ceil(df.count() / BLOCK_ROWS)) for df in (left, right))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("__a", F.pmod(F.hash("query"), F.lit(n_left))).withColumn("__b", numbers(n_right))
    b = right.select(F.col("ord").cast("long").alias("ord"), "vector").withColumn("__b", F.pmod(F.hash("ord"), F.lit(n_right))).withColumn("__a", numbers(n_left))
    a, b = (df.withColumn("__size", F.size("vector")) for df in (a, b))
    block = ["__a", "__b", "__size"]
    found = a.groupBy(*block).cogroup(b.groupBy(*block)).applyInPandas(_best, "query string, ord long, cosine double")
    best = found.groupBy("query").agg(F.max(F.struct("cosine", (-F.col("ord")).alias("o"))).alias("x")).select("query", (-F.col("x.o")).alias("ord"), "x.cosine")
    names = profiles.select(F.col("ord").cast("long").alias("ord"), "speaker").distinct()
    kept = best if threshold is None else best.filter(F.col("cosine") >= threshold)
    return kept.join(names, "ord").select("query", "speaker", "ord", "cosine")


def enrol(samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """``speaker, centroid, sample_count, sample_ids``: profiles with the new samples of their speakers.

    ``samples`` has ``speaker, sample_id, vector``. Samples already in their profile are left out, so enrolling twice
    changes nothing; the new centroid is the unit vector of the mean weighted by the numbers of samples. Speakers
    without a profile get one; profiles without new samples stay as they are.
    """
    known = profiles.select("speaker", F.explode("sample_ids").alias("sample_id"))
    new = samples.dropDuplicates(["speaker", "sample_id"]).join(known, ["speaker", "sample_id"], "left_anti")
    means = mean_vectors(new, ["speaker"], "vector").withColumnRenamed("n", "__n")
    ids = new.groupBy("speaker").agg(F.array_sort(F.collect_list("sample_id")).alias("__ids"))
    old = profiles.select("speaker", F.col("centroid").alias("__old"), F.col("sample_count").cast("long").alias("__count"), F.col("sample_ids").alias("__had"))
    joined = old.join(means.join(ids, "speaker"), "speaker", "full")
    both = F.zip_with("__old", "mean", lambda a, b: (a * F.col("__count") + b * F.col("__n")) / (F.col("__count") + F.col("__n")))
    centroid = F.when(F.col("mean").isNull(), F.transform("__old", lambda x: x.cast("double"))).when(F.col("__old").isNull(), unit(F.col("mean"))).otherwise(unit(both))
    none = F.array().cast("array<string>")
    return joined.select("speaker", centroid.alias("centroid"), (F.coalesce("__count", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("sample_count"), F.concat(F.coalesce("__had", none), F.coalesce("__ids", none)).alias("sample_ids"))


def sample_id(session: Column, turn_id: Column, start_ms: Column) -> Column:
    """``session:turn:seconds`` with two decimals, ``turn`` for a missing session."""
    return F.concat_ws(":", F.coalesce(session, F.lit("turn")), turn_id.cast("string"), F.format_string("%.2f", start_ms / 1000))


def profiles_of_named(embeddings: DataFrame, names: DataFrame, profiles: DataFrame, prefix: str = "SPEAKER_") -> DataFrame:
    """``speaker, vector``: profiles, each averaged with the unit mean of the vectors of clusters that have its name by now; names without a profile get that mean.

    ``embeddings`` has ``session_id, cluster_id, vector``, ``names`` ``session_id, cluster_id, name``, ``profiles``
    ``speaker, vector``. Blank names and placeholders don't count.
    """
    real = names.filter(F.col("name").isNotNull() & (F.col("name") != "") & ~F.col("name").startswith(prefix)).select("session_id", "cluster_id", F.col("name").alias("speaker"))
    means = mean_vectors(embeddings.join(real, ["session_id", "cluster_id"]), ["speaker"], "vector").select("speaker", unit(F.col("mean")).alias("__mean"))
    both = profiles.select("speaker", F.transform("vector", lambda x: x.cast("double")).alias("__old")).join(means, "speaker", "full")
    mixed = unit(F.zip_with("__old", "__mean", lambda a, b: (a + b) / 2))
    return both.select("speaker", F.when(F.col("__mean").isNull(), F.col("__old")).when(F.col("__old").isNull(), F.col("__mean")).otherwise(mixed).alias("vector"))


def unsafe_sources(aligned: DataFrame) -> DataFrame:
    """``session_id, source_turn_id`` whose runs are uncertain or don't agree in speaker and cluster."""
    runs = aligned.withColumn("source_turn_id", F.coalesce("source_turn_id", "turn_id"))
    found = runs.groupBy("session_id", "source_turn_id").agg(F.bool_or("uncertain").alias("u"), F.count_distinct("speaker").alias("s"), F.count_distinct("cluster_id").alias("c"))
    return found.filter("u or s > 1 or c > 1").select("session_id", "source_turn_id")


def representative_runs(aligned: DataFrame) -> DataFrame:
    """The run that stands for each source turn: its own id first, then the earliest."""
    source = F.coalesce("source_turn_id", "turn_id")
    key = F.struct((F.col("turn_id") != source).alias("other"), "start_ms", "turn_id")
    return aligned.groupBy("session_id", source.alias("source_turn_id")).agg(F.min_by("turn_id", key).alias("turn_id"), F.min_by("start_ms", key).alias("start_ms"))


def average_linkage(vectors: np.ndarray, n_clusters: int | None, distance: float | None) -> np.ndarray:
    """Labels by average linkage over cosine distances, until ``n_clusters`` are left or the nearest two are ``distance`` or more apart."""
    n = len(vectors)
    if n < 2:
        return np.zeros(n, int)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    u = vectors / np.where(length > 0, length, 1)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - max(1, min(n_clusters or 1, n))):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        if distance is not None and n_clusters is None and d[i, j] >= distance:
            break
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def _nearest_in_blocks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each cluster of the left block the nearest one of the right block (ties: smaller id), by average linkage of unit vectors."""
    if not len(left) or not len(right):
        return pd.DataFrame({"session_id": pd.Series(dtype="str"), "c": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64"), "near": pd.Series(dtype="int64")})
    right = right.sort_values("c")
    mean = lambda x: np.stack(x["total"].to_numpy()) / x["n"].to_numpy()[:, None]
    d = 1 - mean(left) @ mean(right).T
    d[left["c"].to_numpy()[:, None] == right["c"].to_numpy()[None, :]] = np.inf
    at = d.argmin(1)
    return pd.DataFrame({"session_id": left["session_id"].to_numpy(), "c": left["c"].to_numpy(), "d": d[np.arange(len(at)), at], "near": right["c"].to_numpy()[at]})


def linked_in_rounds(rows: DataFrame, distance: float, block: int = 2000) -> DataFrame:
    """``session_id, id, c``: average linkage of sessions of any size; ``c`` is the smallest id of the cluster.

    The average distance of two clusters of unit vectors needs their sums and sizes only, and merging two clusters that
    are each other's nearest never brings a third one nearer, so all such pairs below ``distance`` are merged at once, in
    rounds, until none is left: the result is that of merging one pair at a time. In a round the clusters of a session
    are compared in pairs of blocks.
    """
    now = cut(rows.select("session_id", F.col("id").alias("c"), unit(F.col("vector")).alias("total"), F.lit(1).cast("long").alias("n")))
    member = rows.select("session_id", "id", F.col("id").alias("c"))
    while True:
        sizes = now.groupBy("session_id").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
        numbered = now.join(F.broadcast(sizes), "session_id").withColumn("own", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
        a, b = numbered.withColumn("a", F.col("own")).withColumn("b", other), numbered.toDF(*numbered.columns).withColumn("b", F.col("own")).withColumn("a", other)
        key = ["session_id", "a", "b"]
        found = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(_nearest_in_blocks, "session_id string, c long, d double, near long")
        nearest = cut(found.groupBy("session_id", "c").agg(F.min(F.struct("d", "near")).alias("x")).filter(F.col("x.d") < distance).select("session_id", "c", "x.near"))
        back = nearest.select("session_id", F.col("c").alias("near"), F.col("near").alias("c"))
        pairs = cut(nearest.join(back, ["session_id", "c", "near"]).filter("c < near"))
        if pairs.isEmpty():
            return member
        gone = pairs.select("session_id", F.col("near").alias("c"), F.col("c").alias("into"))
        merged = pairs.join(now, ["session_id", "c"]).join(now.select("session_id", F.col("c").alias("near"), F.col("total").alias("more"), F.col("n").alias("m")), ["session_id", "near"])
        merged = merged.select("session_id", "c", F.zip_with("total", "more", lambda x, y: x + y).alias("total"), (F.col("n") + F.col("m")).alias("n"))
        touched = gone.select("session_id", "c").unionByName(pairs.select("session_id", "c"))
        now = cut(now.join(touched, ["session_id", "c"], "left_anti").unionByName(merged))
        member = cut(member.join(gone, ["session_id", "c"], "left").select("session_id", "id", F.coalesce("into", "c").alias("c")))


def recluster(embeddings: DataFrame, n_clusters: int | None = None, distance: float | None = 0.6, most: int = 5000) -> DataFrame:
    """``session_id, id, label``: clusters of the vectors of each session by average linkage, numbered by first appearance.

    Sessions of up to ``most`` vectors are clustered in one task each, larger ones by ``linked_in_rounds``, with the same
    result; a fixed number of clusters is possible for the former only (an error for the latter). Null vectors are left out.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        label = average_linkage(np.stack(rows["vector"].to_numpy()).astype(float), n_clusters, distance)
        return pd.DataFrame({"session_id": rows["session_id"], "id": rows["id"], "label": [f"SPEAKER_{i:02d}" for i in pd.factorize(label)[0]]})

    rows = embeddings.filter(F.col("vector").isNotNull()).select(F.col("session_id").cast("string").alias("session_id"), F.col("id").cast("long").alias("id"), "vector")
    large = cut(rows.groupBy("session_id").count().filter(F.col("count") > most).select("session_id"))
    small = rows.join(F.broadcast(large), "session_id", "left_anti").groupBy("session_id").applyInPandas(run, "session_id string, id long, label string")
    if large.isEmpty():
        return small
    if n_clusters is not None or distance is None:
        raise ValueError(f"a fixed number of clusters needs sessions of at most {most} vectors")
    found = linked_in_rounds(rows.join(F.broadcast(large), "session_id"), distance)
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("c")) - 1
    names = found.select("session_id", "c").distinct().select("session_id", "c", F.format_string("SPEAKER_%02d", number).alias("label"))
    return small.unionByName(found.join(names, ["session_id", "c"]).select("session_id", "id", "label"))
