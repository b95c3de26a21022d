"""Clean speaker turns out of noisy transcripts: one name per person, only spoken words, ordered turns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.names import MASTER_NAMES, name_score, name_tokens, sounded
from voxframe.llm.runs import collapse_runs, folded_label
from voxframe.llm.vectors import grouped
from voxframe.operators.joins import joined_spread
from voxframe.session import cut

#: A clock time, an offset like 12m05s (fixed patterns).
CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
OFFSET = r"(?:\d{1,2}h)?\d{1,3}m\d{1,2}s"
#: Time marks in brackets, with or without a second time, and decoder marks like <|12.34|>.
TIME_IN_BRACKETS = rf"[\[(<]\s*(?:{CLOCK}|{OFFSET})(?:\s*(?:-->|->|-|–|→)\s*(?:{CLOCK}|{OFFSET}))?\s*[\])>]|<\|[^|<>]*\|>"
#: A bare time at the beginning counts as a mark only with a separator behind it; without one it may be spoken.
TIME_BEFORE_TEXT = rf"^\s*(?:{CLOCK}|{OFFSET})\s*(?:-->\s*(?:{CLOCK})?|->|→|\||-|–)"
#: Words (beginnings) that make a bracket a note on sounds or on the recording (fixed values).
NOTE_WORDS = "rire rires rit rigol ricane toux tousse soupir silence bruit musique applaud inaudible incompr indistinct micro claque grince souffl chuchot murmur sonnerie siffl raclement etern hesit pause laugh cough sigh noise music applause crosstalk".split()
#: Hesitation sounds: euh, heu, hum, hm, mmh, mhm and longer ones, also joined by hyphens.
HESITATION = r"(?:e+u+h+|h+e+u+h*|e+u{2,}|h+u+m+|h+m+|m{2,}h*|m+h+m*)"
#: Name before the speech: up to a colon, maybe after a dash or in bold.
NAME_BEFORE_TEXT = r"^\s*(?:[-–•]\s*)?(?:\*\*)?\s*([^:*\n]+?)\s*(?:\*\*)?\s*:(?:\s*\*\*)?\s*"
#: What a further cluster of one person counts less, in votes.
FURTHER = 0.001


def without_time_marks(text: Column) -> Column:
    marked = F.when(text.rlike(r"[\[(<]"), F.regexp_replace(text, TIME_IN_BRACKETS, " ")).otherwise(text)
    return F.when(marked.rlike(r"^\s*\d"), F.regexp_replace(marked, TIME_BEFORE_TEXT, " ")).otherwise(marked)


def without_dash(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*[-–|•]+(?=\s|\*|\p{L})", " ")


def spoken_words(text: Column) -> Column:
    """The spoken words of a text without time marks and names before it: no notes, no hesitation sounds.

    Stars, braces, angle brackets and music notes always hold notes; round and square brackets do if one of their words
    is of a sound or the recording, else what they hold is spoken.
    """
    note = "|".join(NOTE_WORDS)
    t = F.replace(text, F.lit("**"), F.lit(" "))
    t = F.when(t.rlike(r"[*{<♪]"), F.regexp_replace(t, r"\*[^*\n]+\*|\{[^{}]*\}|<[^<>]*>|♪[^♪]*♪|♪", " ")).otherwise(t)
    plain = rf"(?iU)[\(\[]+[^()\[\]]*\b(?:{note.replace('etern', '[eé]tern').replace('hesit', 'h[eé]sit')})[^()\[\]]*[\)\]]+"
    t = F.when(t.rlike(r"[(\[]"), F.regexp_replace(t, plain, " ")).otherwise(t)
    words = F.split(t, r"(?U)\s+")
    # a word holds a letter or digit and isn't a hesitation sound
    word = rf"(?iU)^(?![^\p{{L}}\p{{N}}]*{HESITATION}(?:[-’']{HESITATION})*[^\p{{L}}\p{{N}}]*$)[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]"
    return F.filter(words, lambda w: w.rlike(word))


def person_keys(people: DataFrame) -> DataFrame:
    """``campaign, key, person``: every usual folded label of a person."""
    user, character = folded_label("username"), folded_label("character")
    first = folded_label(F.regexp_extract("character", r"^\s*(\S+)", 1))
    masters = F.when(F.coalesce("is_dm", F.lit(False)), F.array(*[F.lit(m) for m in sorted(MASTER_NAMES)])).otherwise(F.array().cast("array<string>"))
    named = F.array_compact(F.concat(F.array(character, first), masters, F.transform(F.coalesce("nicknames", F.array().cast("array<string>")), folded_label)))
    both = F.transform(named, lambda n: F.concat(n, user))
    keys = F.array_compact(F.concat(F.array(user), named, both))
    return people.select("campaign", F.explode(keys).alias("key"), F.col("username").alias("person")).filter("campaign is not null and person is not null").distinct()


def label_key(label: Column) -> Column:
    """Folded label without a track number before it."""
    return folded_label(F.regexp_replace(label, r"^\s*\d+\s*-\s*", ""))


def _phonetic(column: str):
    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        def codes(v: str | None) -> list[str]:
            found = [sounded(t) for t, _ in name_tokens(v)] if v else []
            return sorted({t[0] + "".join(c for c in t[1:] if c not in "aeiouyhw0123456789")[:3] for t in found})

        return values.map(codes)

    return run(column)


def _label_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [name_score(n, u or "", c or "", tuple(k for k in (() if ks is None else ks) if k), bool(d)) for n, u, c, ks, d in zip(b["label"], b["username"], b["character"], b["nicknames"], b["is_dm"], strict=True)]
        yield b[["campaign", "label", "username"]].assign(score=found)[lambda x: x["score"] > 0]


def name_before(text: Column) -> Column:
    """Folded name before the speech, null without one."""
    return F.when(text.contains(":"), label_key(F.regexp_extract(text, NAME_BEFORE_TEXT, 1)))


def resolve_labels(labels: DataFrame, people: DataFrame) -> DataFrame:
    """``campaign, label, persons``: for distinct labels, the people of the campaign whom the label may name.

    Usual labels match by their folded form. Other labels are compared with the people that share a phonetic code of a
    token (first letter and next consonants, one spelling per sound), and name the one that fits best.
    """
    asked = labels.filter("campaign is not null and label is not null").select("campaign", "label").distinct().withColumn("key", label_key(F.col("label")))
    keys = person_keys(people).groupBy("campaign", "key").agg(F.array_sort(F.collect_set("person")).alias("persons"))
    usual = asked.filter("key is not null").join(keys, ["campaign", "key"]).select("campaign", "label", "persons")
    rest = asked.filter("key is not null").join(keys.select("campaign", "key"), ["campaign", "key"], "left_anti").select("campaign", "label", F.explode(_phonetic("label")).alias("code"))
    plain = F.array_compact(F.concat(F.array("character"), F.coalesce("nicknames", F.array().cast("array<string>"))))
    coded = people.filter("campaign is not null and username is not null").withColumn("part", F.explode(plain)).select("campaign", "username", F.explode(_phonetic("part")).alias("code")).distinct()
    pairs = rest.join(coded, ["campaign", "code"]).select("campaign", "label", "username").distinct().join(people.dropDuplicates(["campaign", "username"]), ["campaign", "username"])
    scored = pairs.select("campaign", "label", "username", "character", "nicknames", "is_dm").mapInPandas(_label_scores, "campaign string, label string, username string, score double")
    best = scored.groupBy("campaign", "label").agg(F.max("score").alias("score")).join(scored, ["campaign", "label", "score"])
    return usual.unionByName(best.groupBy("campaign", "label").agg(F.array_sort(F.collect_set("username")).alias("persons")))


def optimal_assignment(gain: np.ndarray) -> np.ndarray:
    """Column of each row in a one-to-one assignment of greatest total gain (-1: none), by shortest augmenting paths."""
    n, m = gain.shape
    if n > m:
        back = optimal_assignment(gain.T)
        found = np.full(n, -1)
        found[back[back >= 0]] = np.flatnonzero(back >= 0)
        return found
    cost = gain.max(initial=0) - gain
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[column]:
            seen[column] = True
            i = owner[column]
            slack = cost[i - 1] - u[i] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], column
            free = np.where(seen, np.inf, least)
            free[0] = np.inf
            following = int(free.argmin())
            step = free[following]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            column = following
        while column:
            owner[column] = owner[way[column]]
            column = way[column]
    found = np.full(n, -1)
    found[owner[1:][owner[1:] > 0] - 1] = np.flatnonzero(owner[1:] > 0)
    return found


def cluster_persons(gain: np.ndarray) -> np.ndarray:
    """Person of each cluster by an assignment of greatest total gain, where ``gain`` (clusters x persons) holds the votes.

    A person may own several clusters, each further one for ``FURTHER`` of a vote less: every person has as many columns as
    clusters that vote for them. So votes decide, and among equals a person who has no cluster yet. If every cluster's best
    person is ahead by more than all these reductions, each takes it: no assignment is better.
    """
    best = gain.argmax(1)
    ordered = np.sort(gain, 1)
    ahead = ordered[:, -1] - (ordered[:, -2] if gain.shape[1] > 1 else 0)
    if (ahead > FURTHER * len(gain)).all():
        return best
    owner = np.concatenate([np.full(n, p) for p, n in enumerate((gain > 0).sum(0))])
    copy = np.concatenate([np.arange(n) for n in (gain > 0).sum(0)])
    chosen = optimal_assignment(np.where(gain[:, owner] > 0, np.maximum(gain[:, owner] - FURTHER * copy, 1e-9), 0))
    return np.where(chosen >= 0, owner[chosen], best)


def _assigned(_: int, votes: pa.Table) -> pa.RecordBatch:
    found = []
    for session, rows in votes.to_pandas().groupby("session", sort=False):
        cluster, clusters = pd.factorize(rows["cluster"], sort=True)
        person, persons = pd.factorize(rows["person"], sort=True)
        gain = np.zeros((len(clusters), len(persons)))
        np.add.at(gain, (cluster, person), rows["votes"].to_numpy(float))
        found.append((np.repeat(session, len(clusters)), clusters, persons[cluster_persons(gain)]))
    return pa.record_batch([pa.array(np.concatenate(x), pa.string()) for x in zip(*found, strict=True)], names=["session", "cluster", "cluster_person"])


def clean_turns(turns: DataFrame, people: DataFrame, max_gap: int = 2000) -> DataFrame:
    """``session, turn_id, person, start_ms, end_ms, n_rows, n_words``: clean turns in order of time.

    ``turns`` has ``session, campaign, turn_id, s, e`` (whole milliseconds), ``speaker, cluster, text``; ``people`` has
    ``campaign, username, character, nicknames, is_dm``. A row belongs to the person whom its label names in the
    campaign's roster, else to the person whom its cluster has elsewhere in the session. Rows without a spoken word are
    left out; rows that belong to nobody give no turn but part their neighbours. Neighbouring rows of one person, each
    starting at most ``max_gap`` after the latest end so far, are one turn. Null starts, sessions and turn ids are left
    out, a null text has no words, repeated rows count once, ties are ordered by turn_id, an empty table gives no rows.
    """
    resolved = cut(resolve_labels(turns.select("campaign", F.col("speaker").alias("label")), people))
    unique = resolved.withColumn("named", F.when(F.size("persons") == 1, F.get("persons", 0)))
    labelled = turns.groupBy("campaign", "speaker").agg(F.count("*").alias("n")).join(unique.withColumnRenamed("label", "speaker"), ["campaign", "speaker"])
    rows = joined_spread(turns, labelled, ["campaign", "speaker"], "turn_id", "left").drop("n")
    votes = rows.filter("cluster is not null and persons is not null").select("session", "cluster", F.explode("persons").alias("person"), (1 / F.size("persons")).alias("votes"))
    votes = votes.groupBy("session", "cluster", "person").agg(F.sum("votes").alias("votes"))
    # one row per cluster and person of a session, however many turns it has
    sessions = votes.withColumn("group", F.xxhash64("session")).repartition("group").sortWithinPartitions("group", "session", "cluster", "person")
    assigned = cut(sessions.mapInArrow(grouped(_assigned, "group"), "session string, cluster string, cluster_person string"))
    counted = rows.filter("cluster is not null").groupBy("session", "cluster").agg(F.count("*").alias("n")).join(assigned, ["session", "cluster"])
    owned = joined_spread(rows, counted, ["session", "cluster"], "turn_id", "left").withColumn("person", F.coalesce("named", "cluster_person"))
    names = person_keys(people).groupBy("campaign").agg(F.collect_set("key").alias("keys"))
    text = without_dash(without_time_marks(without_time_marks(F.coalesce("text", F.lit("")))))
    cleaned = cut(owned.select("session", "campaign", "turn_id", "s", "e", "person", text.alias("text")).withColumn("before", name_before(F.col("text"))))
    # of the distinct names before speeches, those of the campaign's people
    spoken_names = cleaned.filter("before is not null").groupBy("campaign", "before").agg(F.count("*").alias("n")).join(names, "campaign").filter(F.array_contains("keys", F.col("before"))).select("campaign", "before", "n", F.lit(True).alias("is_name"))
    named = joined_spread(cleaned, spoken_names, ["campaign", "before"], "turn_id", "left")
    speech = F.when(F.col("is_name"), without_time_marks(F.regexp_replace("text", NAME_BEFORE_TEXT, " "))).otherwise(F.col("text"))
    counted = named.withColumn("n_words", F.size(spoken_words(speech)).cast("long")).filter("n_words > 0")
    counted = counted.withColumn("person", F.coalesce("person", F.lit("")))
    runs = collapse_runs(counted, "session", "s", "e", "turn_id", "person", max_gap, ("n_words",))
    return runs.filter("label <> ''").select("session", F.col("first_key").alias("turn_id"), F.col("label").alias("person"), "start_ms", "end_ms", "n_rows", "n_words")
