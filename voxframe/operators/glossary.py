"""A glossary of names and rare words out of notes, and the part of it that helps with a chunk of text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from voxframe.operators.joins import joined_spread
from voxframe.operators.lore import ELIDED, clean_name, strip_control_tokens
from voxframe.operators.refine import likeness
from voxframe.session import cut

#: A word: begins with a letter, may go on with apostrophes and hyphens.
WORD = r"(?U)(?!_)[^\W\d]\w*(?:['’\-]\w+)*"
#: Longest term (a fixed value).
TERM_CHARS = 120
#: Version of the rules, part of the hash of a glossary.
RULES = "1"
#: Characters of a reference list, least letters and greatest difference in length of like words, and their likeness (fixed values).
REFERENCE_CHARS, LIKE_CHARS, LIKE_DIFFERENCE, LEAST_LIKENESS = 4000, 4, 2, 0.8
#: Variants with at most so many first words are found by a broadcast of these; more of them by a shuffle.
BROADCAST_WORDS = 20_000
#: Words are looked up by so many first characters; like words of which the shorter has at most so many meet without the letters they don't share.
HEAD_CHARS, REDUCED_CHARS = 8, 10


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    """Composed Unicode, case folded; null for null."""
    return text.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def usable_term(text: Column) -> Column:
    """A cleaned name of at most ``TERM_CHARS`` characters that holds a word, else null. The text is composed already."""
    name = clean_name(text)
    return F.when((F.length(name) <= TERM_CHARS) & name.rlike(WORD), name)


def note_parts(notes: DataFrame) -> DataFrame:
    """``path, source, lines, blocks`` of notes: their lines without embedded files and fenced code, and the blocks of metadata.

    A block begins with a line ``key:`` (and a line of dashes before it) and ends with the next line of dashes; without
    one there is no block. Control characters in texts and null texts are no trouble; a null text gives no row.
    """
    text = strip_control_tokens(F.replace(composed("text"), F.lit("\r\n"), F.lit("\n")))
    text = F.regexp_replace(text, r"!\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"(?ms)^\s*(`{3,}|~{3,}).*?^\s*\1[^\n]*(?:\n|\z)", "")
    rows = notes.filter("text is not null").select("path", "source", F.split(text, "\n").alias("lines"))
    numbers = lambda pattern: F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
    marked = rows.withColumn("__dashes", numbers(r"^---[ \t]*$")).withColumn("__keys", numbers(r"^[A-Za-z_]+:"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("blocks"))

    def close(state: Column, dash: Column) -> Column:
        key = F.array_min(F.filter("__keys", lambda k: (k >= state["at"]) & (k < dash)))
        first = F.when((key - 1 >= state["at"]) & F.get("lines", key - 1).rlike(r"^---[ \t]*$"), key - 1).otherwise(key)
        block = F.struct(first.cast("int").alias("first"), dash.cast("int").alias("last"))
        return F.when(key.isNull(), state).otherwise(F.struct((dash + 1).cast("int").alias("at"), F.concat(state["blocks"], F.array(block)).alias("blocks")))

    return marked.select("path", "source", "lines", F.aggregate("__dashes", start, close)["blocks"].alias("blocks"))


def _linked(text: Column) -> Column:
    """Text with links replaced by what they mean (what they show if they mean nothing)."""
    text = F.regexp_replace(text, r"\[\[(?:[^\S\n]*|[^\]\n#|]{%d,})(?:#[^\]\n|]*)?\|([^\]\n]*)\]\]" % (TERM_CHARS + 1), "$1")
    return F.regexp_replace(text, r"\[\[([^\]\n#|]*)(?:#[^\]\n|]*)?(?:\|[^\]\n]*)?\]\]", "$1")


def note_lines(parts: DataFrame) -> DataFrame:
    """``path, source, line_no, line``: visible lines of notes, white space made one; metadata, addresses, tags, code and marks are left out."""
    outside = F.filter("lines", lambda x, i: ~F.exists("blocks", lambda b: (b["first"] <= i) & (i <= b["last"])))
    text = _linked(F.array_join(outside, "\n"))
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"https?://\S+|<[^>]*>|`[^`]*`", "")
    rows = parts.select("path", "source", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d+\.\s+|>\s*)", ""), r"(?U)\s+", " "))
    return rows.select("path", "source", "line_no", plain.alias("line")).filter("line <> ''")


def note_names(parts: DataFrame) -> DataFrame:
    """``path, phase, pos, name, alias``: names that notes link to, with what the link shows (phase 1), and headings after metadata, with the aliases named there (phase 0); ``alias`` is null where there is none."""
    block = F.explode("blocks")
    metadata = parts.select("path", "lines", block.alias("b"))
    after = F.slice("lines", F.col("b.last") + 2, F.size("lines") + 1)
    heading = F.regexp_extract(F.get(F.filter(after, lambda x: F.trim(x) != ""), 0), r"^\s*#{1,6}\s+(.+)$", 1)
    inside = F.slice("lines", F.col("b.first") + 1, F.col("b.last") - F.col("b.first") + 1)
    listed = F.array_position(F.transform(inside, lambda x: x.rlike(r"^aliases:[ \t]*$")), True)
    # items follow the line of the aliases directly; the first other line ends them
    rest = F.when(listed > 0, F.slice(inside, listed.cast("int") + 1, F.size("lines") + 1)).otherwise(F.array().cast("array<string>"))
    others = F.array_min(F.transform(rest, lambda x, i: F.when(~x.rlike(r"^[ \t]+-"), i)))
    items = F.transform(F.slice(rest, F.lit(1), F.coalesce(others, F.size(rest))), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*-\s*", ""), "^[\"']+|[\"']+$", ""))
    first = metadata.select("path", F.lit(0).alias("phase"), F.col("b.first").alias("pos"), heading.alias("name"), F.explode_outer(items).alias("alias"))
    text = F.array_join(F.filter("lines", lambda x, i: ~F.exists("blocks", lambda b: (b["first"] <= i) & (i <= b["last"]))), "\n")
    links = F.regexp_extract_all(text, F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))
    target = lambda x: F.substring_index(F.substring_index(x, "|", 1), "#", 1)
    shown = lambda x: F.when(x.contains("|"), F.substring(x, F.length(F.substring_index(x, "|", 1)) + 2, F.length(x)))
    second = parts.select("path", F.posexplode(links).alias("pos", "x")).select("path", F.lit(1).alias("phase"), "pos", target(F.col("x")).alias("name"), shown(F.col("x")).alias("alias"))
    both = first.unionByName(second)
    return both.select("path", "phase", "pos", usable_term(F.col("name")).alias("name"), usable_term(F.col("alias")).alias("alias")).filter("name is not null")


def variants_of(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``variant, key``: normalized names, and aliases of one name only that are no names and have a word that isn't in ``lexicon(term)``.

    ``names`` has ``key`` and ``alias_key`` (normalized, null for none).
    """
    own = names.select(F.col("key").alias("variant"), "key").distinct()
    aliases = names.filter("alias_key is not null and alias_key <> key").groupBy("alias_key").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key")).filter("n = 1")
    aliases = aliases.select(F.col("alias_key").alias("variant"), "key").join(own.select("variant"), "variant", "left_anti")
    words = aliases.select("variant", F.explode(F.regexp_extract_all("variant", F.lit(WORD), F.lit(0))).alias("term"))
    unknown = words.join(lexicon.select("term").distinct(), "term", "left_anti").select("variant").distinct()
    return own.unionByName(aliases.join(unknown, "variant", "left_semi"))


def _taken(lines: DataFrame, variants: DataFrame) -> DataFrame:
    """``line, pieces, taken``: variants that stand in distinct lines, longest first and without overlap: their keys and places.

    A line is cut into words and what is between; a stretch of words that begins with the first word of a variant and has
    as many words is looked up. First words are few, so they are broadcast as long as there are at most ``BROADCAST_WORDS``.
    """
    pieces = F.regexp_extract_all("norm", F.lit(r"(?U)\w+|\W+"), F.lit(0))
    cut_lines = lines.select("line", pieces.alias("pieces"))
    parts = F.regexp_extract_all("variant", F.lit(r"(?U)\w+|\W+"), F.lit(0))
    sized = variants.select("variant", "key", parts.alias("p")).filter(F.get("p", 0).rlike(r"(?U)^\w"))
    firsts = sized.groupBy(F.get("p", 0).alias("word")).agg(F.collect_set(F.size("p")).alias("sizes"))
    few = firsts.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    words = cut_lines.select("line", F.posexplode("pieces").alias("at", "word"), "pieces").filter(F.col("word").rlike(r"(?U)^\w"))
    if few:
        begun = words.join(F.broadcast(firsts), "word")
    else:
        begun = joined_spread(words, words.groupBy("word").agg(F.count("*").alias("n")).join(firsts, "word"), ["word"], "line")
    asked = begun.select("line", "at", F.explode("sizes").alias("size"), "pieces")
    stretch = F.array_join(F.slice("pieces", F.col("at") + 1, F.col("size")), "")
    candidates = cut(asked.filter(F.col("at") + F.col("size") <= F.size("pieces")).select("line", "at", "size", stretch.alias("variant")))
    counted = candidates.groupBy("variant").agg(F.count("*").alias("n")).join(variants, "variant")
    found = joined_spread(candidates, counted, ["variant"], "line")
    order = F.array_sort(F.collect_list(F.struct((-F.length("variant")).alias("long"), "variant", "at", "size", "key")))
    lists = found.groupBy("line").agg(order.alias("found"))
    free = lambda state, x: ~F.exists(state, lambda y: (x["at"] < y["at"] + y["size"]) & (y["at"] < x["at"] + x["size"]))
    none = F.array().cast("array<struct<at:int,size:int,key:string>>")
    take = lambda state, x: F.when(free(state, x), F.concat(state, F.array(F.struct(x["at"].cast("int").alias("at"), x["size"].cast("int").alias("size"), x["key"].alias("key"))))).otherwise(state)
    return lists.select("line", F.aggregate("found", none, take).alias("taken"))


def context_glossary(notes: DataFrame, lexicon: DataFrame, extra_terms: Sequence[str] = (), language: str = "fr") -> DataFrame:
    """``key, term, frequency, aliases, sources`` in the order of falling frequency, then key.

    ``notes`` has ``path`` (orders the files), ``source`` (what is listed) and ``text``; ``lexicon`` has ``term``, the
    ordinary words in small letters. Names are what notes link to, headings after metadata, and ``extra_terms``; they
    count at least 1. In a line the longest names and aliases are taken first (an alias counts for its name if it means one
    name only, is no name itself and isn't made of ordinary words); of the rest, words of two characters or more that are
    not ordinary count, but for elisions before ordinary words in French. A line that stands in several files counts in the
    first of them, there each time; all its sources are listed. The first spelling is kept. Null texts give nothing, empty
    tables only the extra terms.

    Lines are made distinct before they are searched, so a line in a third of all files is searched once. Names that
    begin with a mark aren't found in lines.
    """
    spark = notes.sparkSession
    parts = cut(note_parts(notes))
    lexicon = lexicon.select(F.lower("term").alias("term")).filter("term is not null").distinct()
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(extra_terms)], "pos int, name string")
    extra = extra.select(F.lit(None).cast("string").alias("path"), F.lit(-1).alias("phase"), "pos", usable_term(composed("name")).alias("name"), F.lit(None).cast("string").alias("alias")).filter("name is not null")
    rows = note_names(parts).withColumn("path", F.col("path").cast("string")).unionByName(extra)
    names = cut(rows.withColumn("key", normalized("name")).withColumn("alias_key", normalized("alias")))
    variants = cut(variants_of(names, lexicon))
    lines = note_lines(parts)
    # distinct lines: the first file with its number of repeats, the sources of all
    per_file = lines.groupBy("line", "path").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"), F.first("source").alias("source"))
    distinct = cut(per_file.groupBy("line").agg(F.min(F.struct("path", "line_no", "n")).alias("x")).select("line", F.col("x.path").cast("string").alias("path"), "x.line_no", "x.n", normalized("line").alias("norm")))
    sources = lines.select("line", "source").distinct()
    taken = distinct.join(_taken(distinct, variants), "line", "left")
    pieces = F.regexp_extract_all("line", F.lit(r"(?U)\w+|\W+"), F.lit(0))
    covered = lambda i: F.exists(F.coalesce("taken", F.array().cast("array<struct<at:int,size:int,key:string>>")), lambda y: (y["at"] <= i) & (i < y["at"] + y["size"]))
    rest = F.array_join(F.transform(pieces, lambda p, i: F.when(covered(i), F.lit(" ")).otherwise(p)), "")
    taken = cut(taken.select("line", "path", "line_no", "n", F.coalesce(F.transform("taken", lambda y: y["key"]), F.array().cast("array<string>")).alias("keys"), F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)).alias("words")))
    words = taken.select("line", "path", "line_no", "n", F.posexplode("words").alias("pos", "word")).filter("length(word) >= 2")
    spelled = words.groupBy("word").agg(F.min(F.struct("path", "line_no", "pos")).alias("at"), F.count("*").alias("n")).withColumn("low", F.lower("word"))
    unknown = spelled.join(lexicon.select(F.col("term").alias("low")), "low", "left_anti").filter(F.length("word") <= TERM_CHARS)
    if language == "fr":
        halves = F.split("low", "[’']")
        unknown = unknown.withColumn("term", F.when((F.size(halves) == 2) & F.get(halves, 0).isin(ELIDED), F.get(halves, 1))).join(lexicon.withColumn("__known", F.lit(True)), "term", "left").filter("__known is null").drop("term", "__known")
    unknown = cut(unknown.withColumn("key", normalized("word")))
    hits = taken.select("line", "n", F.explode("keys").alias("key")).unionByName(joined_spread(words.select("line", "word", F.col("n").alias("times")), unknown.select("word", "key", "n"), ["word"], "line").select("line", F.col("times").alias("n"), "key"))
    hits = cut(hits.groupBy("line", "key").agg(F.sum("n").alias("n")))
    counts = hits.groupBy("key").agg(F.sum("n").alias("frequency"))
    listed = hits.select("line", "key").join(sources, "line").groupBy("key").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    first = names.groupBy("key").agg(F.min_by("name", F.struct(F.coalesce("path", F.lit("")), "phase", "pos")).alias("name"), F.max(F.lit(True)).alias("is_name"))
    other = names.filter("alias_key <> key").groupBy("key").agg(F.transform(F.array_sort(F.collect_set(F.struct("alias_key", "alias"))), lambda x: x["alias"]).alias("aliases"))
    found = unknown.groupBy("key").agg(F.min_by("word", "at").alias("word"))
    joined = first.join(counts, "key", "full").join(found, "key", "left").join(other, "key", "left").join(listed, "key", "left")
    none = F.array().cast("array<string>")
    frequency = F.when(F.col("is_name"), F.greatest(F.lit(1), F.coalesce("frequency", F.lit(0)))).otherwise(F.col("frequency")).cast("long")
    return joined.select("key", F.coalesce("name", "word").alias("term"), frequency.alias("frequency"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("sources", none).alias("sources")).orderBy(F.col("frequency").desc(), "key")


def glossary_hash(notes: DataFrame, language: str, extra_terms: Sequence[str] = (), buckets: int = 4096) -> DataFrame:
    """``source_hash``: SHA-256 over the paths and contents of all files, the language and the extra terms.

    Hashes are joined in ``buckets`` first, so no list of all files is made.
    """
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    each = notes.select(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("b"), F.concat_ws(":", F.col("path").cast("string"), content).alias("h"))
    joined = each.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("h")), ";"), 256).alias("h"))
    whole = joined.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ";").alias("h"))
    return whole.select(F.sha2(F.to_json(F.struct(F.lit(RULES).alias("rules"), F.lit(language).alias("language"), F.array(*[F.lit(t) for t in extra_terms]).cast("array<string>").alias("extra"), "h")), 256).alias("source_hash"))


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substring(text, i, F.lit(size))))


def _reductions(length: int, other: int) -> int:
    """Letters that a word of ``length`` and one of ``other`` letters have in common at least if they are alike."""
    return -(-2 * (length + other) // 5)


@F.pandas_udf(ArrayType(StringType()))
def _reduced(words: pd.Series) -> pd.Series:
    """What is left of a word without the letters that it need not share with a like word; a word and a like one of at most ``REDUCED_CHARS`` letters (the shorter) have one of these in common."""

    def keys(word: str) -> list[str]:
        n = len(word)
        kept = {_reductions(n, k) for k in range(max(LIKE_CHARS, n - LIKE_DIFFERENCE), n + LIKE_DIFFERENCE + 1) if min(n, k) <= REDUCED_CHARS}
        return sorted({"".join(x) for m in kept if m <= n for x in combinations(word, m)})

    return words.map(keys)


def _alike(words: DataFrame, variants: DataFrame) -> DataFrame:
    """``word, variant``: distinct words and variants of four characters or more that differ by at most two in length and have a likeness of 0.8 or more.

    Such pairs have a common subsequence of 0.4 of their joined length, so short ones meet by an equi-join of what is left of
    them without the other letters. Long ones, which are rare as words, would have too many of these; they meet by two neighbouring characters.
    """
    words, variants = words.filter(F.length("word") >= LIKE_CHARS), variants.filter(F.length("variant") >= LIKE_CHARS)
    apart = F.abs(F.length("word") - F.length("variant")) <= LIKE_DIFFERENCE
    common = F.ceil((F.length("word") + F.length("variant")) * 2 / 5)
    short = F.lit(REDUCED_CHARS + LIKE_DIFFERENCE)
    left = words.filter(F.length("word") <= short).select("word", F.explode(_reduced("word")).alias("part"))
    right = variants.filter(F.length("variant") <= short).select("variant", F.explode(_reduced("variant")).alias("part"))
    reduced = left.join(right, "part").filter(apart & (F.length("part") == common)).select("word", "variant").distinct()
    long_words, long_variants = words.filter(F.length("word") > REDUCED_CHARS), variants.filter(F.length("variant") > REDUCED_CHARS)
    pairs = long_words.select("word", F.explode(_grams(F.col("word"), 2)).alias("gram")).join(long_variants.select("variant", F.explode(_grams(F.col("variant"), 2)).alias("gram")), "gram")
    pairs = pairs.filter(apart).groupBy("word", "variant").agg(F.count("*").alias("shared"))
    # what is in common stands in stretches parted by what only one of them has
    gaps = F.greatest(F.length("word"), F.length("variant")) - common
    likely = pairs.filter(F.col("shared") >= F.least(F.lit(1), common - gaps - 1)).select("word", "variant")
    return reduced.unionByName(likely).filter(likeness("word", "variant") >= LEAST_LIKENESS)


def _word_matches(words: DataFrame, variants: DataFrame) -> DataFrame:
    """``word, key, variant``: distinct words by which entries may be relevant; ``variant`` is null where the word alone makes the entry relevant, else what the text has to hold too.

    ``variants`` has ``key, variant``. A variant of one word stands in a text if it stands in a word of it. Of another the
    longest word is looked up, which is a whole word of the text, but for the side where the variant ends.
    """
    tokens = F.regexp_extract_all("variant", F.lit(r"(?U)[^\W_]+"), F.lit(0))
    sized = variants.select("key", "variant", F.array_min(F.transform(tokens, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"].alias("token")).filter("token is not null")
    at = F.expr("instr(variant, token)")
    sized = sized.select("key", "variant", "token", (at > 1).alias("before"), (at + F.length("token") <= F.length("variant")).alias("after"), F.left("token", F.lit(HEAD_CHARS)).alias("head"))
    heads = words.select("word", F.explode(F.array_distinct(F.concat(*[_grams(F.col("word"), n) for n in range(1, HEAD_CHARS + 1)]))).alias("head"))
    fits = F.contains("word", "token") & (~F.col("before") | F.startswith("word", "token")) & (~F.col("after") | F.endswith("word", "token"))
    inside = heads.join(sized, "head").filter(fits).select("word", "key", F.when(F.col("before") | F.col("after"), F.col("variant")).alias("variant"))
    near = _alike(words, variants.select("variant").distinct()).join(variants, "variant").select("word", "key", F.lit(None).cast("string").alias("variant"))
    return inside.unionByName(near).distinct()


def relevant_entries(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk, keys``: entries one of whose variants stands in the text of the chunk, or is like one of its words; a chunk may have several rows.

    ``entries`` has ``key, term, aliases``, ``chunks`` has ``chunk, text``; ``keys`` has the type of ``key``. Alike are a variant and a word of four
    characters or more that differ by at most two in length and have a likeness of 0.8 or more. Variants are compared
    with the distinct words of all texts, not with the texts, and a text is read only for a variant of several words of which it has
    the longest. Words of many chunks are spread.
    """
    variants = cut(entries.select("key", F.explode(F.concat(F.array("term"), "aliases")).alias("v")).select("key", normalized("v").alias("variant")).filter("variant <> ''").distinct())
    texts = cut(chunks.filter("text is not null").select("chunk", normalized("text").alias("text")))
    words = texts.select("chunk", F.explode(F.array_distinct(F.split("text", r"(?U)[\W_]+"))).alias("word")).filter("word <> ''")
    counted = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    matches = _word_matches(counted.select("word"), variants)
    lists = matches.groupBy("word").agg(F.collect_set(F.when(F.col("variant").isNull(), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("variant").isNotNull(), F.struct("key", "variant"))).alias("asked"))
    found = joined_spread(words, cut(lists.join(counted, "word")), ["word"], "chunk")
    asked = found.filter(F.size("asked") > 0).select("chunk", F.explode("asked").alias("x")).select("chunk", "x.key", "x.variant")
    # variants without a word are looked up by their first mark
    marks = texts.select("chunk", F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"(?U)[^\W_]+", ""), ""))).alias("mark")).filter("mark <> ''")
    bare = variants.filter(~F.col("variant").rlike(r"(?U)[^\W_]")).select("key", "variant", F.left("variant", F.lit(1)).alias("mark"))
    asked = asked.unionByName(marks.join(bare, "mark").select("chunk", "key", "variant"))
    held = asked.join(texts, "chunk").filter(F.contains("text", "variant")).select("chunk", F.array("key").alias("keys"))
    return found.filter(F.size("keys") > 0).select("chunk", "keys").unionByName(held)


def _packing(common: Sequence[int], limit: int, least: int) -> Callable[[pd.Series], pd.Series]:
    """Entries of each list, then of ``common``, that are taken in turn as long as they fit; an entry is its rank times ``limit`` plus its size."""
    sizes = np.array([x % limit for x in common], np.int64)

    @F.pandas_udf(ArrayType(LongType()))
    def packed(lists: pd.Series) -> pd.Series:
        def pack(own: Sequence[int] | None) -> list[int]:
            # each entry takes its length and a comma or the closing bracket
            room, taken = limit - 1, []
            for x in np.unique(own).tolist() if own is not None else []:
                if x % limit < room:
                    taken.append(x)
                    room -= x % limit + 1
                if room <= least:
                    return taken
            once, at = set(taken), 0
            while room > least and at < len(sizes):
                fits = np.flatnonzero(sizes[at : at + 500] < room)
                if not len(fits):
                    at += 500
                    continue
                at += int(fits[0]) + 1
                if (x := common[at - 1]) not in once:
                    taken.append(x)
                    room -= x % limit + 1
            return taken

        return lists.map(pack)

    return packed


def reference_lists(entries: DataFrame, chunks: DataFrame, limit: int = REFERENCE_CHARS) -> DataFrame:
    """``chunk, terms, reference``: for each chunk a compact JSON list of at most ``limit`` characters of whole entries.

    Relevant entries come first, then by falling frequency, key and term; one that doesn't fit is skipped. Entries that
    aren't relevant are the same for all chunks: of each size only the first that could fill the list alone are kept, so
    this list, which the driver gets as numbers, is bounded by ``limit``, whatever the glossary. Chunks with a null text have no row.

    Entries travel as numbers that rise with their rank and hold their size; what they say is joined to those taken.
    """
    coded = entries.select("key", "term", "aliases", F.to_json(F.struct("term", "aliases", "frequency")).alias("json"), "frequency").withColumn("size", F.length("json")).filter(F.col("size") <= limit - 2)
    # the numbers rise from partition to partition of the sorted entries
    coded = cut(coded.orderBy(F.col("frequency").desc(), "key", "term").withColumn("code", F.monotonically_increasing_id() * limit + F.col("size")))
    most = F.floor(F.lit(limit) / (F.col("size") + 1)) + 1
    top = coded.select("size", "code", F.row_number().over(Window.partitionBy("size").orderBy("code")).alias("n")).filter(F.col("n") <= most)
    common = sorted(r.code for r in top.select("code").collect())
    packed = _packing(common, limit, min((x % limit for x in common), default=limit))
    # all entries of a key are relevant if one of them is
    keyed = coded.select(F.collect_list("code").over(Window.partitionBy("key")).alias("key"), "term", "aliases")
    own = relevant_entries(keyed, chunks).select("chunk", F.flatten("keys").alias("codes"))
    own = own.groupBy("chunk").agg(F.flatten(F.collect_list("codes")).alias("codes"))
    every = chunks.filter("text is not null").select("chunk").distinct().join(own, "chunk", "left")
    picked = cut(every.select("chunk", packed("codes").alias("codes")))
    rows = picked.select("chunk", F.posexplode("codes").alias("at", "code"))
    said = rows.groupBy("code").agg(F.count("*").alias("n")).join(coded.select("code", "term", "json"), "code")
    lists = joined_spread(rows, said, ["code"], "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "term", "json"))).alias("k"))
    none = F.array().cast("array<struct<at:int,term:string,json:string>>")
    kept = picked.select("chunk").join(lists, "chunk", "left").select("chunk", F.coalesce("k", none).alias("k"))
    return kept.select("chunk", F.transform("k", lambda x: x["term"]).alias("terms"), F.concat(F.lit("["), F.array_join(F.transform("k", lambda x: x["json"]), ","), F.lit("]")).alias("reference"))
