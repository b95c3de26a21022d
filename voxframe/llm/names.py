"""Linking of typed names to the people of a roster, by blocks of misspelled forms and longest common subsequences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.session import cut

#: Shortest token that means a part of a name by its beginning alone.
LEAST_CUT = 3
#: Tokens of so many letters may miss two of them, shorter ones only one.
TWO_MISSED = 9
#: Longest token of which all forms with letters left out are made, and the stretch that longer ones share: a fifth of what is left of 33 letters without two.
LONG_CHARS, STRETCH_CHARS = 32, 7
#: Least ratio of the longest common subsequence for two tokens to be one name, misspelled.
LEAST_RATIO = 0.8
#: Titles that may stand before or after a name, folded (fixed values).
TITLES = frozenset("capitaine dame dom don dona frere lady lord madame maitre maitresse messire mme monsieur m mr mrs ms sieur sire sir ser soeur docteur dr pere mere".split())
#: Usual names of the game master, folded and without spaces (fixed values).
MASTER_NAMES = frozenset("mj lemj maitredujeu lemaitredujeu meneurdejeu lemeneurdejeu meneur maitre dm gm gamemaster dungeonmaster".split())
#: Words that make a name one of a relative, a place or a group (fixed values).
NOT_A_PERSON = frozenset("de du des la les le of the guilde ordre tour marches port clan maison chateau".split())


@lru_cache(maxsize=200_000)
def folded(text: str) -> str:
    """Small letters and digits of a text, without accents; everything else becomes a space."""
    text = text.lower().replace("œ", "oe").replace("æ", "ae").replace("ß", "ss").replace("ø", "o")
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in plain)


def sounded(token: str) -> str:
    """A folded token with spellings of one sound made equal."""
    return re.sub(r"qu(?=[aeiouy])", "k", token.replace("ph", "f")).replace("ck", "k")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, all rows of a column at once: the bits of a number are the letters of ``a``, those set to 0 count."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_bits = every
    for y in b:
        same = open_bits & places.get(y, 0)
        open_bits = ((open_bits + same) | (open_bits - same)) & every
    return len(a) - open_bits.bit_count()


@lru_cache(maxsize=500_000)
def likeness(a: str, b: str) -> float:
    """The greater ratio of two tokens as written and as sounded, 0 where it is too low for a misspelling."""
    return max(_ratio(a, b), _ratio(sounded(a), sounded(b)))


def _ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    longest, shortest = max(len(a), len(b)), min(len(a), len(b))
    missed = 1 if longest < TWO_MISSED else 2
    if shortest < 4 or longest - shortest > missed:  # no common subsequence can be long enough
        return 0.0
    shared = common_length(a, b)
    ratio = 2 * shared / (len(a) + len(b))
    return ratio if longest - shared <= missed and ratio >= LEAST_RATIO else 0.0


@lru_cache(maxsize=200_000)
def name_tokens(name: str) -> tuple[tuple[str, bool], ...]:
    """Folded tokens of a typed name without section anchors and titles; whether each was cut short by a dot."""
    name = re.sub(r"#.*", "", name, flags=re.S)
    name = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", name)
    found = []
    for word in re.findall(r"[^\W_]+\.?", name):
        token = folded(word).replace(" ", "")
        if token:
            found.append((token, word.endswith(".")))
    kept = [t for t in found if t[0] not in TITLES]
    return tuple(kept or found)


@lru_cache(maxsize=200_000)
def person_parts(character: str, nicknames: tuple[str, ...], is_dm: bool) -> tuple[tuple[str, ...], int, tuple[str, ...]]:
    """Parts of a person's name and the nicknames, the number of the former, and the parts written together."""
    names = folded(character).split() if not is_dm else []
    given = [n for nick in nicknames for n in [folded(nick).replace(" ", "")] if n]
    joined = ["".join(names), "".join(reversed(names)), *(g + names[-1] for g in given)] if len(names) > 1 else []
    return (*names, *given), len(names), tuple(joined)


def name_score(name: str, username: str, character: str, nicknames: tuple[str, ...], is_dm: bool) -> float:
    """How well a typed name means a person, 0 if it doesn't.

    It means the person if it is the user name, a usual name of the game master (for the game master), or if every token
    is a part of the character's name or a nickname, maybe misspelled or cut short, in any order, no part being used
    twice, and at least one token is more than an initial. Parts written together count as well.
    """
    whole = folded(name).replace(" ", "")
    if not whole:
        return 0.0
    if username and whole == folded(username).replace(" ", ""):
        return 3.0
    if whole in MASTER_NAMES:
        return 2.0 if is_dm else 0.0
    tokens = name_tokens(name)
    if any(t in NOT_A_PERSON for t, _ in tokens):
        return 0.0
    parts, n_names, joined = person_parts(character, nicknames, is_dm)
    if len(tokens) == 1 and n_names > 1:
        best = max(likeness(tokens[0][0], j) for j in joined)
        if best:
            return best + n_names - 1
    free, total, real = list(parts), 0.0, False
    for token, short in sorted(tokens, key=lambda t: (-len(t[0]), t[0])):
        scores = []
        for part in free:
            like = likeness(token, part)
            cut = len(token) < len(part) and part.startswith(token) and (short or len(token) == 1 or len(token) >= 4)
            scores.append((max(like, 0.7 if cut else 0.0), like > 0 or (cut and len(token) >= 3)))
        best = max(range(len(scores)), key=lambda i: scores[i][0], default=None)
        if best is None or not scores[best][0]:
            return 0.0
        total += scores[best][0]
        real |= scores[best][1]
        free.pop(best)
    return total if real else 0.0


def _misspelled(token: str) -> set[str]:
    """Keys of which two tokens share one if ``_ratio`` takes them for one name.

    Both have their longest common subsequence, and miss it by one letter, or by two from ``TWO_MISSED`` letters on: so
    it is among the forms of either with so many letters left out. Of long tokens these would be many; with four letters
    missed in both together, such tokens share a stretch of a fifth of the rest.
    """
    keys = {"~" + token}
    if 5 <= len(token) <= LONG_CHARS:
        forms = {token}
        for _ in range(1 if len(token) < TWO_MISSED else 2):
            forms |= {f[:i] + f[i + 1 :] for f in forms for i in range(len(f))}
        keys |= {"~" + f for f in forms}
    if len(token) >= LONG_CHARS - 1:
        keys |= {"^" + token[i : i + STRETCH_CHARS] for i in range(len(token) - STRETCH_CHARS + 1)}
    return keys


def _probes(name: str) -> list[tuple[bool, str]]:
    """What to look for of a typed name, and whether any one of these is enough: each token of three letters or more has to mean a part of the person's name."""
    whole = folded(name).replace(" ", "")
    found = [(False, "=" + whole), *([(False, "=master")] if whole in MASTER_NAMES else [])] if whole else []
    tokens = list(dict.fromkeys(t for t, _ in name_tokens(name)))
    if not whole or whole in MASTER_NAMES or NOT_A_PERSON & set(tokens):
        return found
    long = [t for t in tokens if len(t) >= LEAST_CUT]
    return found + [(bool(long), "~" + t) for t in long or tokens]


@lru_cache(maxsize=50_000)
def _probe_keys(probe: str) -> list[str]:
    if probe[0] == "=":
        return [probe]
    return sorted(_misspelled(probe[1:]) | _misspelled(sounded(probe[1:])) | {"<" + probe[1:]})


def _person_keys(username: str, character: str, nicknames: tuple[str, ...], is_dm: bool) -> list[str]:
    """Keys of the user name, and of the parts of the name as ``name_score`` compares them: misspelled, cut short, written together."""
    parts, _, joined = person_parts(character, nicknames, is_dm)
    keys = {"=" + folded(username).replace(" ", ""), *(["=master"] if is_dm else [])}
    for part in {*parts, *joined}:
        keys |= _misspelled(part) | _misspelled(sounded(part))
    return sorted(keys | {"<" + p[:n] for p in parts for n in range(LEAST_CUT, len(p))})


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("choice", T.BooleanType()), T.StructField("probe", T.StringType())])))
def _probes_of(names: pd.Series) -> pd.Series:
    return names.map(lambda n: [{"choice": c, "probe": p} for c, p in _probes(n)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys_of_probe(probes: pd.Series) -> pd.Series:
    return probes.map(_probe_keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys_of_person(usernames: pd.Series, characters: pd.Series, nicknames: pd.Series, masters: pd.Series) -> pd.Series:
    return pd.Series([_person_keys(u or "", c or "", tuple(k for k in (() if ks is None else ks) if k), bool(d)) for u, c, ks, d in zip(usernames, characters, nicknames, masters, strict=True)], dtype=object)


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [name_score(n, u or "", c or "", tuple(k for k in (() if ks is None else ks) if k), bool(d)) for n, u, c, ks, d in zip(b["name"], b["username"], b["character"], b["nicknames"], b["is_dm"], strict=True)]
        yield b[["campaign", "name", "person"]].assign(score=found)[lambda x: x["score"] > 0]


def link_names(names: DataFrame, people: DataFrame) -> DataFrame:
    """``campaign, name, person``: the person of the same campaign whom a typed name means, if there is one.

    ``names`` has ``campaign, name``, ``people`` has ``campaign, person`` (long), ``username, character, nicknames
    (array), is_dm``. Equal names of a campaign are compared once. Null campaigns and null or wordless names mean
    nobody; a name that means two people equally well means nobody. Repeated rows change nothing; empty tables give no
    rows.

    Candidates are all pairs that the score can accept, as both have a key of ``_misspelled``, a beginning or a whole name
    in common. A name of several tokens is looked up by the one that the fewest people share, so a common name is
    refined by the others and never dropped.
    """
    typed = names.filter("campaign is not null and name is not null").select("campaign", "name").distinct()
    roster = people.filter("campaign is not null and person is not null").dropDuplicates(["campaign", "person"])
    keys = _keys_of_person("username", "character", F.coalesce("nicknames", F.array().cast("array<string>")), F.coalesce("is_dm", F.lit(False)))
    # a row has hundreds of keys, which the planner doesn't foresee: without the hint it broadcasts them
    # a block is a key of a campaign, as one number; the keys of a person are distinct
    index = roster.select("campaign", "person", F.explode(keys).alias("key")).select("person", F.xxhash64("campaign", "key").alias("block"))
    asked = cut(typed.select("campaign", "name", F.inline(_probes_of("name"))))
    probes = asked.select("campaign", "probe").distinct()
    hits = cut(probes.select("campaign", "probe", F.explode(_keys_of_probe("probe")).alias("key")).select("campaign", "probe", F.xxhash64("campaign", "key").alias("block")).join(index.hint("merge"), "block").select("campaign", "probe", "person").distinct())
    sizes = hits.groupBy("campaign", "probe").agg(F.count("*").alias("n"))
    rarest = asked.filter("choice").join(sizes, ["campaign", "probe"], "left").groupBy("campaign", "name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "probe")).alias("x")).select("campaign", "name", "x.probe")
    chosen = rarest.unionByName(asked.filter("not choice").select("campaign", "name", "probe"))
    pairs = chosen.join(hits, ["campaign", "probe"]).select("campaign", "name", "person").distinct()
    wide = pairs.join(roster.select("campaign", "person", "username", "character", "nicknames", "is_dm"), ["campaign", "person"])
    scored = cut(wide.mapInPandas(_scores, "campaign string, name string, person long, score double"))
    best = scored.groupBy("campaign", "name").agg(F.max(F.struct("score", "person")).alias("top"), F.max("score").alias("score"))
    rivals = scored.join(best, ["campaign", "name", "score"]).groupBy("campaign", "name").agg(F.count_distinct("person").alias("n"), F.max("top.person").alias("person"))
    return rivals.filter("n = 1").select("campaign", "name", "person")
