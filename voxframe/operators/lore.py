"""Names and terms out of notes: entities, ordered distinct names, prompts within a budget, and a glossary."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank of an entity by its kind (fixed values); other kinds come last.
PRIORITIES = {"speaker": 0, "character": 0, "nickname": 0, "custom": 1, "wikilink": 2, "alias": 3, "heading": 4}
#: Endings of embedded media, which are no names (fixed values).
MEDIA = "png jpg jpeg webp gif svg pdf mp3 wav flac".split()
#: A word: begins with a letter, may go on with apostrophes and hyphens.
WORD = r"\p{L}[\p{L}\p{N}]*(?:['’\-][\p{L}\p{N}]+)*"


def _until_steady(text: Column, step: Callable[[Column], Column], left: Column) -> Column:
    """``step`` once for every text, and ``left`` times more (each time but the last changes something) for those that still hold one of its marks."""
    again = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), left)), text, lambda t, _: step(t))
    return F.when(left > 0, again).otherwise(text)


def strip_control_tokens(text: Column) -> Column:
    """Text without ``<|...|>`` (on one line), innermost first until none is left, and without what is left of their brackets, until none is left."""
    count = lambda t, part: F.size(F.split(t, part)) - 1
    token = lambda t: F.regexp_replace(t, r"<\|[^<\n]*?(?:<(?!\|)[^<\n]*?)*?\|>", "")
    bare = lambda t: F.replace(F.replace(F.replace(t, F.lit("<|"), F.lit("")), F.lit("|>"), F.lit("")), F.lit("<>"), F.lit(""))
    text = token(text)
    text = bare(_until_steady(text, token, F.when(text.contains("<|"), count(text, r"\|>")).otherwise(0)))
    return _until_steady(text, bare, F.when(text.rlike(r"<\||\|>|<>"), count(text, "[<>|]")).otherwise(0))


def clean_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(strip_control_tokens(text), r"(?U)\s+", " "))


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def priority(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(kind)), F.lit(5))


def extract_entities(notes: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """``doc_id, kind, pos, name``: wikilinks, items of the first ``aliases:`` block and level-2 headings of Markdown notes.

    The alias of a link wins over its target, section anchors are dropped, media files and stop words are skipped,
    repeats are kept. Null texts give nothing.
    """
    text = F.col("text")
    links = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    shown = F.transform(links, lambda x: F.when(x.contains("|"), F.substring_index(x, "|", -1)).otherwise(F.substring_index(x, "#", 1)))
    block = F.regexp_extract(text, r"(?m)^aliases:[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|$))+)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^##[ \t]+([^#\n]+)"), F.lit(1))

    def of_kind(kind: str, names: Column) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    parts = [of_kind("wikilink", shown), of_kind("alias", items), of_kind("heading", heads)]
    rows = notes.filter("text is not null").select("doc_id", F.posexplode(F.concat(*parts)).alias("pos", "e")).select("doc_id", "e.kind", "pos", clean_name(F.col("e.name")).alias("name"))
    media = F.lower("name").rlike(r"\.(" + "|".join(MEDIA) + r")$")
    kept = rows.filter((F.col("name") != "") & ~media)
    return kept.filter(~F.lower("name").isin(list(stop_words))) if stop_words else kept


def ordered_distinct(*sources: DataFrame, keys: Sequence[str] = ("campaign_id",)) -> DataFrame:
    """``keys, name, rank, ord``: each name once, where it first stands in the sources (each ``keys, name, ord``) in their order."""
    ranked = [s.select(*keys, "name", F.lit(i).alias("rank"), F.col("ord").cast("long").alias("ord")) for i, s in enumerate(sources)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    first = rows.filter("name is not null").groupBy(*keys, "name").agg(F.min(F.struct("rank", "ord")).alias("x"))
    return first.select(*keys, "name", "x.rank", "x.ord")


def biasing_prompt(entities: DataFrame, max_tokens: int = 180) -> DataFrame:
    """``campaign_id, prompt``: the names of a campaign by priority, each once whatever its case, up to the first that overflows the budget of words.

    ``entities`` has ``campaign_id, ord, name, kind``. A campaign whose first name overflows has the empty prompt.
    """
    cleaned = entities.select("campaign_id", "ord", clean_name(F.col("name")).alias("name"), priority(F.col("kind")).alias("p")).filter("name <> ''")
    once = cleaned.groupBy("campaign_id", F.lower("name").alias("k")).agg(F.min(F.struct("p", "ord", "name")).alias("x")).select("campaign_id", "x.*")
    order = Window.partitionBy("campaign_id").orderBy("p", "ord", "name").rowsBetween(Window.unboundedPreceding, 0)
    # a name has a word at least, so names past the budget's number never count
    near = once.withColumn("n", F.row_number().over(Window.partitionBy("campaign_id").orderBy("p", "ord", "name"))).filter(F.col("n") <= max_tokens + 1)
    summed = near.withColumn("total", F.sum(count_words(F.col("name"))).over(order))
    fits = F.when(F.col("total") <= max_tokens, F.struct("n", "name"))
    return summed.groupBy("campaign_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(fits)), lambda x: x["name"]), ", ").alias("prompt"))


def visible_lines(notes: DataFrame) -> DataFrame:
    """``doc_id, source, line_no, line``: visible text of notes by line: no front matter, code, links' brackets, URLs, HTML or list marks; spaces made one."""
    t = strip_control_tokens(F.regexp_replace("text", r"\r\n?", "\n"))
    t = F.regexp_replace(t, r"(?s)^---\n.*?\n---[ \t]*(?=\n|$)|```.*?```", "")
    t = F.regexp_replace(t, r"!\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)|`[^`\n]*`|https?://\S+|<[^<>\n]*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1"), r"\[([^\[\]]*)\]\([^)]*\)", "$1")
    rows = notes.filter("text is not null").select("doc_id", "source", F.posexplode(F.split(t, "\n")).alias("line_no", "line"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*(?:[#>]+|[-*+]\s|\d+\.\s)\s*", ""), r"(?U)\s+", " "))
    return rows.withColumn("line", plain).filter("line <> ''")


def owned_lines(lines: DataFrame) -> DataFrame:
    """``line, doc_id, n``: the document in which a line counts, the first of those it stands in, and how often it stands there.

    Repeats are counted by line and document first, so a line that a third of all documents share is combined before the shuffle.
    """
    counted = lines.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    return counted.groupBy("line").agg(F.min(F.struct("doc_id", "n")).alias("x")).select("line", "x.doc_id", "x.n")


def term_frequencies(lines: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``term, frequency, n_sources``: words of two letters or more, small, counted over owned lines; sources over all lines. Words of ``lexicon(term)`` are left out."""
    words = lambda df, *c: df.select(*c, F.explode(F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0))).alias("term")).filter("length(term) >= 2")
    counts = words(owned_lines(lines), "n").groupBy("term").agg(F.sum("n").alias("frequency"))
    sources = words(lines.select("source", "line").distinct(), "source").groupBy("term").agg(F.count_distinct("source").alias("n_sources"))
    joined = counts.join(sources, "term")
    return joined if lexicon is None else joined.join(lexicon.select("term").distinct(), "term", "left_anti")


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """``alias, name`` of aliases that mean one name only and are no name themselves; ``aliases`` has ``alias, name``."""
    single = aliases.groupBy("alias").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).filter("n = 1")
    return single.join(aliases.select(F.col("name").alias("alias")).distinct(), "alias", "left_anti").select("alias", "name")


def pack_reference(terms: DataFrame, keys: Sequence[str], limit: int = 4000) -> DataFrame:
    """``keys, terms, n_chars``: terms in the order of ``rank`` packed greedily into a JSON list of at most ``limit`` characters; one that doesn't fit is skipped.

    A term takes its length + 2, the list 2 and a comma between terms. Where a term doesn't fit, no later one of its
    length does, so of each length only the first terms that could fill the list alone are folded; of lengths that never
    fit one term is kept, for the row of its key.
    """
    size = F.least(F.coalesce(F.length("term"), F.lit(limit)), F.lit(limit))
    ranked = terms.withColumn("__size", size).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__size").orderBy("rank", "term")))
    near = ranked.filter(F.col("__n") <= F.greatest(F.lit(1), F.floor(F.lit(limit) / (F.col("__size") + 2))))
    lists = near.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("t"))
    start = F.struct(F.lit(2).alias("n"), F.array().cast("array<string>").alias("picked"))

    def step(a: Column, x: Column) -> Column:
        size = a["n"] + F.length(x) + 2 + F.when(F.size(a["picked"]) > 0, 1).otherwise(0)
        return F.when(size <= limit, F.struct(size.alias("n"), F.concat(a["picked"], F.array(x)).alias("picked"))).otherwise(a)

    folded = F.aggregate("t", start, step)
    return lists.select(*keys, folded.alias("f")).select(*keys, F.col("f.picked").alias("terms"), F.col("f.n").alias("n_chars"))


#: What may be elided before a French word (fixed values).
ELIDED = "c d j l m n s t qu jusqu lorsqu puisqu".split()


def without_known_elisions(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Terms but those of an elided particle and a word of ``lexicon(term)``, like ``l'eau``."""
    parts = F.split(F.regexp_replace("term", "’", "'"), "'")
    elided = F.when((F.size(parts) == 2) & F.get(parts, 0).isin(ELIDED), F.get(parts, 1))
    known = lexicon.select(F.col("term").alias("__suffix")).distinct()
    return terms.withColumn("__suffix", elided).join(known.withColumn("__known", F.lit(True)), "__suffix", "left").filter("__known is null").drop("__suffix", "__known")


def speaker_prompt_entities(roster: DataFrame, entities: DataFrame) -> DataFrame:
    """``campaign_id, ord, name, kind`` for a prompt of a recording with several tracks: characters and nicknames first, then the lore; user names are left out."""
    people = roster.select("campaign_id", F.col("ord"), F.inline(F.concat(F.array(F.struct(F.col("character_name").alias("name"), F.lit("character").alias("kind"))), F.transform(F.coalesce("nicknames", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit("nickname").alias("kind"))))))
    users = roster.select("campaign_id", F.col("discord_username").alias("name")).distinct()
    lore = entities.select("campaign_id", (F.col("ord") + 1_000_000).alias("ord"), "name", "kind").join(users, ["campaign_id", "name"], "left_anti")
    return people.filter("name is not null").unionByName(lore.filter("name is not null")).distinct()
