"""Plug-ins that make rows of files: speech recognition, diarization, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schemas of what the kinds of plug-ins return for each path.
SCHEMAS = {
    "segments": "path string, id int, start double, end double, text string, words array<struct<word:string,start:double,end:double,probability:double>>, is_truncated boolean",
    "turns": "path string, id int, start double, end double, cluster_id string",
    "embeddings": "path string, entity_id int, embedding array<float>",
}
_FACTORIES: dict[tuple[str, str], Callable[[], Callable[[str], list[dict]]]] = {}


def register(kind: str, name: str, factory: Callable[[], Callable[[str], list[dict]]]) -> None:
    """Register a factory; it is called once in each Python worker and returns a function from a path to rows."""
    if kind not in SCHEMAS:
        raise ValueError(f"unknown kind of engine: {kind}")
    _FACTORIES[kind, name] = factory


def process(files: DataFrame, kind: str, name: str) -> DataFrame:
    """Rows of the engine for every ``path``; files are spread over the tasks as they are partitioned."""
    if (kind, name) not in _FACTORIES:
        raise ValueError(f"unknown engine: {name}")
    factory, schema = _FACTORIES[kind, name], SCHEMAS[kind]
    columns = [c.split()[0] for c in schema.replace("array<struct<word:string,start:double,end:double,probability:double>>", "x").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for batch in batches:
            rows = [{**r, "path": p} for p in batch["path"] for r in engine(p)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path").mapInPandas(run, schema)


def joined_chunks(segments: DataFrame, chunk_seconds: float = 180.0) -> DataFrame:
    """``path, text, words`` of recordings recognised in chunks: word times move by their chunk's offset, texts are joined in order.

    Needs ``path, chunk_no, text, words``.
    """
    moved = F.transform("words", lambda w: F.struct(w["word"].alias("word"), (w["start"] + F.col("chunk_no") * chunk_seconds).alias("start"), (w["end"] + F.col("chunk_no") * chunk_seconds).alias("end"), w["probability"].alias("probability")))
    lists = segments.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", F.trim("text").alias("text"), moved.alias("words")))).alias("c"))
    return lists.select("path", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("text"), F.flatten(F.transform("c", lambda x: x["words"])).alias("words"))
