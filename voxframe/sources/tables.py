"""Readers of files beside a recording, as tables, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a description calls the game master (fixed values).
MASTER = ["le mj", "mj", "maître du jeu", "maitre du jeu", "meneur de jeu", "dm", "gm"]


def parse_roster(lines: DataFrame) -> DataFrame:
    """``source, username, character_name, role, nicknames, is_dm, ord`` from lines ``name: character, role, surnoms: (a, b)``.

    ``lines`` has ``source, line_no, value``. Blank lines and comments are skipped; one list mark may stand first. The
    last line of a user name wins, at the place of the first.
    """
    value = F.trim(F.regexp_replace(F.trim("value"), r"^[-*]\s*", ""))
    rows = lines.withColumn("value", value).filter((F.col("value") != "") & ~F.col("value").startswith("#") & F.col("value").contains(":"))
    name, text = F.trim(F.substring_index("value", ":", 1)), F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1))
    # what stands before the word for nicknames, and what stands behind it: a list in brackets, or all the rest
    halves = F.split("text", r"(?i)\bsurnoms?\s*:", 2)
    head, tail = F.get(halves, 0), F.trim(F.coalesce(F.get(halves, 1), F.lit("")))
    inside = F.when(tail.startswith("(") & tail.contains(")"), F.substring_index(F.substring(tail, F.lit(2), F.length(tail)), ")", 1))
    behind = F.when(inside != "", F.substring(tail, F.length(inside) + 3, F.length(tail))).otherwise(F.lit(""))
    names = F.when(inside != "", inside).otherwise(tail)
    listed = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select("source", "line_no", name.alias("username"), text.alias("text")).withColumn("parts", listed(F.concat(head, F.lit(","), behind))).withColumn("nicknames", listed(names))
    called = "|".join(m.replace(" ", r"\s+") for m in MASTER)
    dm = F.col("text").rlike(rf"(?iU)\b(?:{called})\b")
    first = F.coalesce(F.get("parts", 0), F.when(dm, F.lit("MJ")).otherwise(F.col("username")))
    role = F.array_join(F.slice("parts", F.lit(2), F.size("parts") + 1), ", ")
    parsed = rows.select("source", "line_no", "username", F.when(F.lower(first).isin(MASTER), F.lit("MJ")).otherwise(first).alias("character_name"), F.nullif(role, F.lit("")).alias("role"), "nicknames", dm.alias("is_dm"))
    last = F.max_by(F.struct("character_name", "role", "nicknames", "is_dm"), "line_no")
    return parsed.groupBy("source", "username").agg(last.alias("x"), F.min("line_no").alias("ord")).select("source", "username", "x.*", "ord")


def parse_info(lines: DataFrame) -> DataFrame:
    """``source, line_no, section, key, value`` of an information file: ``key: value`` lines, then the lines after ``tracks:``."""
    rows = lines.filter("trim(value) <> ''").withColumn("t", F.trim("value"))
    marks = rows.filter(F.lower("t") == "tracks:").groupBy("source").agg(F.min("line_no").alias("__from"))
    joined = rows.join(marks, "source", "left").filter("__from is null or line_no <> __from")
    track = F.coalesce(F.col("line_no") > F.col("__from"), F.lit(False))
    key = F.when(track, F.regexp_extract("t", r"^(\d+)", 1)).otherwise(F.lower(F.trim(F.substring_index("t", ":", 1))))
    value = F.when(track, F.trim(F.regexp_replace("t", r"^\d+[-.\s]*", ""))).otherwise(F.trim(F.regexp_extract("t", r"^[^:]*:(.*)$", 1)))
    return joined.select("source", "line_no", F.when(track, F.lit("track")).otherwise(F.lit("header")).alias("section"), key.alias("key"), value.alias("value"))


def track_username(name: Column) -> Column:
    """User of a track file name ``3-name.flac``, else the name without its ending."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"^\d+-(.+)$", 1), F.lit("")), stem)


def track_files(files: DataFrame) -> DataFrame:
    """``name, track_no, username`` of files ``digits-name.flac``, whatever the case of the ending."""
    found = files.filter(F.col("name").rlike(r"(?i)^\d+-.+\.flac$"))
    return found.select("name", F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("track_no"), track_username(F.col("name")).alias("username"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of all Markdown files below a folder; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, hash, size, mtime`` of files below a folder: 16 hex digits of the SHA-256 of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.left(F.sha2("content", 256), F.lit(16)).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """``name, kind`` of a list with one term a line; blank lines and comments are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("name"))
    return rows.filter("name <> '' and not startswith(name, '#')").withColumn("kind", F.lit("custom"))


def read_voice_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``speaker, centroid, sample_count, sample_ids`` of JSON ``{"speakers": {name: {...}}}``; an invalid file gives no rows."""
    schema = "speakers map<string, struct<centroid: array<double>, sample_count: int, sample_ids: array<string>>>"
    files = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return files.select(F.explode("speakers").alias("speaker", "p")).select("speaker", "p.centroid", F.coalesce("p.sample_count", F.lit(1)).alias("sample_count"), F.coalesce("p.sample_ids", F.array().cast("array<string>")).alias("sample_ids"))


#: Schema of a stored mapping of speakers; flat maps of older versions have none of these fields.
MAPPING = "cluster_defaults map<string,string>, slice_overrides map<string,map<string,string>>, turn_overrides map<string,string>, label_sources map<string,string>, splits array<struct<cluster_id:string,at:double,new_cluster_id:string>>"


def parse_mappings(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of stored mappings of speakers; ``files`` has ``session_id, value`` (JSON).

    ``turn_names(session_id, turn_id, name)``, ``slice_names(session_id, time_slice_id, cluster_id, name)``,
    ``cluster_names(session_id, cluster_id, name, source)``, ``splits(session_id, seq, cluster_id, at_ms,
    new_cluster_id)`` and ``corrupt(session_id, value)``. A flat map of older versions holds turns under keys of digits and
    clusters under all other keys. What is no JSON object gives no names and stands in ``corrupt``; null values give nothing.
    """
    flat = F.from_json("value", "map<string,string>")
    parsed = files.select("session_id", "value", F.from_json("value", MAPPING).alias("m"), flat.alias("flat"), F.get_json_object("value", "$").alias("whole"))
    good = F.trim("value").startswith("{") & F.col("whole").isNotNull()
    known = F.exists(F.map_keys("flat"), lambda k: k.isin("cluster_defaults", "slice_overrides", "turn_overrides", "label_sources", "splits", "version"))
    rows = parsed.filter(F.col("value").isNotNull()).withColumn("good", F.coalesce(good, F.lit(False))).withColumn("new", F.coalesce(known, F.lit(False)))
    ok = rows.filter("good")
    digits = lambda k: k.rlike("^[0-9]+$")
    empty = F.create_map().cast("map<string,string>")
    turns = F.when(F.col("new"), F.col("m.turn_overrides")).otherwise(F.map_filter("flat", lambda k, v: digits(k)))
    clusters = F.when(F.col("new"), F.col("m.cluster_defaults")).otherwise(F.map_filter("flat", lambda k, v: ~digits(k)))
    turn_names = ok.select("session_id", F.explode(F.map_filter(F.coalesce(turns, empty), lambda k, v: digits(k) & v.isNotNull())).alias("k", "name"))
    cluster_names = ok.select("session_id", F.explode(F.coalesce(clusters, empty)).alias("cluster_id", "name"), F.coalesce("m.label_sources", empty).alias("s")).filter("name is not null")
    slices = ok.select("session_id", F.explode("m.slice_overrides").alias("slice", "names")).select("session_id", "slice", F.explode("names").alias("cluster_id", "name")).filter("name is not null")
    splits = ok.select("session_id", F.posexplode("m.splits").alias("seq", "x"))
    return {
        "turn_names": turn_names.select("session_id", F.col("k").cast("int").alias("turn_id"), "name"),
        "cluster_names": cluster_names.select("session_id", "cluster_id", "name", F.try_element_at("s", F.col("cluster_id")).alias("source")),
        "slice_names": slices.select("session_id", F.col("slice").try_cast("int").alias("time_slice_id"), "cluster_id", "name").filter("time_slice_id is not null"),
        "splits": splits.select("session_id", "seq", "x.cluster_id", F.round(F.col("x.at") * 1000).cast("long").alias("at_ms"), "x.new_cluster_id"),
        "corrupt": rows.filter("not good").select("session_id", "value"),
    }


def save_mappings(tables: dict[str, DataFrame]) -> DataFrame:
    """``session_id, value``: the JSON that ``parse_mappings`` reads, one row for each session with a name or a split."""
    entries = lambda df, key, value: df.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("x"))
    turns = entries(tables["turn_names"], F.col("turn_id").cast("string"), "name").withColumnRenamed("x", "turn_overrides")
    clusters = entries(tables["cluster_names"], "cluster_id", "name").withColumnRenamed("x", "cluster_defaults")
    sources = entries(tables["cluster_names"].filter("source is not null"), "cluster_id", "source").withColumnRenamed("x", "label_sources")
    in_slice = tables["slice_names"].groupBy("session_id", F.col("time_slice_id").cast("string").alias("k")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster_id", "name")))).alias("names"))
    slices = in_slice.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "names"))).alias("slice_overrides"))
    split = F.struct("seq", "cluster_id", (F.col("at_ms") / 1000).alias("at"), "new_cluster_id")
    splits = tables["splits"].groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(split)), lambda x: F.struct(x["cluster_id"].alias("cluster_id"), x["at"].alias("at"), x["new_cluster_id"].alias("new_cluster_id"))).alias("splits"))
    joined = clusters
    for df in (turns, sources, slices, splits):
        joined = joined.join(df, "session_id", "full")
    return joined.select("session_id", F.to_json(F.struct("cluster_defaults", "slice_overrides", "turn_overrides", "splits", "label_sources")).alias("value"))


def parse_stored_rows(files: DataFrame, name: str, row: str) -> DataFrame:
    """``key, pos`` and the fields of ``row`` of stored rows: ``{"name": [...]}`` or, in older files, the list alone. ``files`` has ``key, value``; what is neither gives no rows."""
    now, old = F.from_json("value", f"struct<`{name}`: array<struct<{row}>>>")[name], F.from_json("value", f"array<struct<{row}>>")
    rows = files.select("key", F.posexplode(F.when(F.trim("value").startswith("["), old).otherwise(now)).alias("pos", "r"))
    return rows.filter("r is not null").select("key", "pos", "r.*")


def track_provenance(files: DataFrame, model_name: str, compute_type: str, prompt_hash: str, language: str = "fr", vad_filter: bool = True, vad_parameters: str = "{}") -> DataFrame:
    """``track`` and where its transcript would come from: settings, size and time of the file. ``files`` has ``path, size, mtime``."""
    settings = {"schema_version": 1, "model_name": model_name, "compute_type": compute_type, "prompt_hash": prompt_hash, "vad_filter": vad_filter, "vad_parameters": vad_parameters, "language": language}
    return files.select(F.element_at(F.split("path", "/"), -1).alias("track"), *[F.lit(v).alias(k) for k, v in settings.items()], F.col("size").cast("long").alias("source_file_size"), F.col("mtime").cast("double").alias("source_file_mtime"))


def glossary_sources(spark: SparkSession, path: str) -> DataFrame:
    """``path, source, hash, text`` of all Markdown files below a folder; the text of one that is no UTF-8 is null, its hash counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    return files.select("path", F.col("path").alias("source"), F.sha2("content", 256).alias("hash"), F.when(F.is_valid_utf8(text), text).alias("text"))


def save_by_media(df: DataFrame, path: str, key: str = "media_hash") -> None:
    """Store rows as Parquet partitioned by media; only the media at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
