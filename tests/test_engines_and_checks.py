from __future__ import annotations

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from voxframe.operators import lore, refine
from voxframe.sources import engines
from voxframe.sources.render import piece_blocks


def test_engine_rows(spark):
    engines.register("turns", "fixed", lambda: lambda path: [{"id": i, "start": i, "end": i + 1.0, "cluster_id": path[-1]} for i in range(2)])
    files = spark.createDataFrame([("/x/a",), ("/x/b",)], "path string")
    assert {(r.path, r.id, r.cluster_id) for r in engines.process(files, "turns", "fixed").collect()} == {("/x/a", 0, "a"), ("/x/a", 1, "a"), ("/x/b", 0, "b"), ("/x/b", 1, "b")}
    with pytest.raises(ValueError, match="unknown engine"):
        engines.process(files, "turns", "none")


def test_chunks_are_joined(spark):
    rows = [("f", 1, " b ", [("b", 1.0, 2.0, 1.0)]), ("f", 0, "a", [("a", 0.5, 1.0, 1.0)])]
    df = spark.createDataFrame(rows, "path string, chunk_no int, text string, words array<struct<word:string,start:double,end:double,probability:double>>")
    r = engines.joined_chunks(df).first()
    assert r.text == "a b" and [(w.word, w.start) for w in r.words] == [("a", 0.5), ("b", 181.0)]


def plain_reason(source: str, repaired: str) -> str | None:
    """The checks of a repaired piece, word by word."""
    if re.search(r"(?m)^\s*(?:###|>\s*\[!)", repaired):
        return "headings or callouts"
    a, b = re.findall(r"[^\W_]+", source.casefold()), re.findall(r"[^\W_]+", repaired.casefold())
    if not b:
        return "no words"
    n = len(source.split())
    if abs(len(repaired.split()) - n) > max(3, int(n * 0.15)):
        return "word count differs"
    match = difflib.SequenceMatcher(None, a, b, autojunk=False)
    if difflib.SequenceMatcher(None, " ".join(a), " ".join(b), autojunk=False).ratio() < 0.8:
        return "text differs"
    return "words differ" if sum(max(j - i, y - x) for kind, i, j, x, y in match.get_opcodes() if kind != "equal") > max(4, int(len(a) * 0.15)) else None


def test_reconstruction_reasons(spark):
    source = "the old smith opens the heavy door with a rusty key tonight"
    cases = [(source, source.upper(), None), (source, source + " a b c d", "word count differs"), (source, source[::-1], "text differs"), (source, None, None), (source, source.replace("heavy", "havy"), None)]
    cases += [(source, "> [!NOTE] x\n" + source, "headings or callouts"), (source, " ... ", "no words"), ("", "", "no words")]
    rng = random.Random(6)
    for _ in range(60):
        words = rng.choices("the old smith opens heavy doors with rusty keys and looks at stars".split(), k=rng.randrange(5, 60))
        other = [rng.choice(["x", w[::-1], w.upper(), w + "s", ""]) if rng.random() < 0.2 else w for w in words]
        cases.append((" ".join(words), " ".join(other), plain_reason(" ".join(words), " ".join(other))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.r for r in df.select("i", refine.reconstruction_reason("a", "b").alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases] and "words differ" in got.values()


def test_notices_of_a_polished_chunk(spark):
    head, said = "### [00:00:01 - 00:00:02] A", "one two three four five six"
    other = "### [00:00:03 - 00:00:04] B"
    plain = f"{head}\n{said}\n{other}\n{said}"
    marked = f"{head}\n{refine.MARKER}\n{said}\n{other}\n{said}"
    cases = [
        (f"{refine.NOTICE}\n\n{plain}", f"{refine.NOTICE}\n\n{plain}", None), (f"{refine.NOTICE}\n\n{plain}", plain, "notice differs"), (plain, f"{refine.NOTICE}\n{plain}", "notice differs"),
        (f"{refine.NOTICE}\n\n{plain}", f"{head}\n{refine.NOTICE}\n{said}\n{other}\n{said}", "notice moved"), (marked, plain, "marker differs"), (marked, f"{head}\n{said}\n{other}\n{refine.MARKER}\n{said}", "marker differs"),
        (marked, marked, None), (plain, "", "empty result"), (plain, said, "headings differ"), (plain, plain + " x" * 6, "word count differs"), (plain, plain + " x" * 5, None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.r for r in df.select("i", refine.rejection(F.col("a"), F.col("b")).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_callouts_of_turns(spark):
    text = "Preamble\n\n### [00:00:01 - 00:00:02] A\n\n> [!NOTE] Hors-jeu / Discussion\n> one two\n> three\n\n### [00:00:02 - 00:00:03] B\n\n" + refine.MARKER + "\nfour > five\n"
    turns = refine.parse_turns(spark.createDataFrame([(1, text), (2, "### [00:00:01 - 00:00:02] A\n\n> [!NOTE] x\n"), (3, None)], "doc_id int, text string"))
    rows = turns.orderBy("turn_no").collect()
    assert [(r.doc_id, r.body, r.out_of_game, r.word_start, r.word_end) for r in rows] == [(1, "one two three", True, 0, 3), (1, "four > five", False, 3, 6)]
    blocks = [r.block for r in piece_blocks(turns.withColumnRenamed("body", "text")).orderBy("turn_no").collect()]
    assert blocks == ["### [00:00:01 - 00:00:02] A\n\n> [!NOTE] Hors-jeu / Discussion\n> one two three\n\n", "### [00:00:02 - 00:00:03] B\n\nfour > five\n\n"]
    assert piece_blocks(turns.withColumnRenamed("body", "text"), False).orderBy("turn_no").first().block.startswith("### A\n\n>")


def test_reconstruction_covers_and_falls_back(spark):
    text = "".join(f"### [00:00:0{i} - 00:00:0{i + 1}] {who}\n\n{said}\n\n" for i, (who, said) in enumerate([("Alex", "one two three"), ("Sam", "four five six seven"), ("Alex", "eight nine ten")], 1))
    turns = refine.parse_turns(spark.createDataFrame([(k, text) for k in range(8)], "doc_id int, text string"))
    chunks = refine.word_chunks(turns, 1500)
    whole = "one two three four five six seven eight nine ten"
    answers = [
        (0, 0, "Sam", 0, 10, whole), (1, 0, "Sam", 1, 10, whole), (2, 0, "Sam", 0, 9, " ".join(whole.split()[:9])), (3, 0, "Sam", 0, 11, whole), (4, 0, "Zoe", 0, 10, whole),
        (5, 0, "Sam", 0, 5, "one two three four five"), (5, 1, "Alex", 5, 10, "six seven eight nine tenth"), (6, 0, "Sam", 0, 10, "entirely other words that nobody said in there at all"),
    ]
    repaired = spark.createDataFrame([(d, 0, *rest) for d, *rest in answers], "doc_id int, chunk_no long, piece_no int, speaker string, word_start int, word_end int, text string")
    reasons = {r.doc_id: r.reason for r in refine.checked_reconstruction(chunks, repaired).collect()}
    assert reasons == {0: None, 1: "words not covered", 2: "words not covered", 3: "words not covered", 4: "unknown speaker", 5: None, 6: "text differs", 7: "no answer"}
    got = refine.reconstruct(chunks, repaired, turns).collect()
    assert [(r.speaker, r.start, r.end, r.text) for r in got if r.doc_id == 0] == [("Sam", "00:00:01", "00:00:04", whole)]
    assert sorted((r.piece_no, r.start, r.end) for r in got if r.doc_id == 5) == [(0, "00:00:01", "00:00:03"), (1, "00:00:02", "00:00:04")]
    assert sorted((r.piece_no, r.speaker) for r in got if r.doc_id == 4) == [(0, "Alex"), (1, "Sam"), (2, "Alex")] and {r.reason for r in got if r.doc_id == 4} == {"unknown speaker"}


def test_notice_moves_before_the_first_heading(spark):
    texts = ["### [a] X\n\nNOTE hello", "no heading NOTE", "### [a] X\n\nhello"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.t for r in df.select("i", refine.hoist_notice(F.col("t"), "NOTE").alias("t")).collect()}
    assert got[0].startswith("NOTE\n\n### [a] X") and got[0].count("NOTE") == 1 and got[1].startswith("NOTE\n\n") and got[2] == texts[2]


def test_prompt_prefers_people(spark):
    roster = spark.createDataFrame([("c", 0, "user1", "Lyra", ["Ly"]), ("c", 1, "user2", "Brakk", None)], "campaign_id string, ord int, discord_username string, character_name string, nicknames array<string>")
    notes = spark.createDataFrame([("c", 0, "The Tower", "wikilink"), ("c", 1, "user1", "custom"), ("c", 2, "lyra", "custom"), ("c", 3, "A very long name", "alias"), ("c", 4, "End", "heading"), ("c", 5, None, "alias")], "campaign_id string, ord int, name string, kind string")
    entities = lore.speaker_prompt_entities(roster, notes)
    prompt = lambda n: lore.biasing_prompt(entities, n).first().prompt
    assert prompt(5) == "Ly, Lyra, Brakk, The Tower" and prompt(9) == "Ly, Lyra, Brakk, The Tower, A very long name" and prompt(8) == prompt(5) and prompt(0) == ""
