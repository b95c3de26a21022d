"""French spoken dice rolls in usual notation, by array functions over the tokens of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spoken numbers of dice (fixed values).
COUNTS = {"un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "six": "6"}
#: Spoken sides of dice (fixed values).
SIDES = {"quatre": "4", "six": "6", "huit": "8", "dix": "10", "douze": "12", "vingt": "20", "cent": "100"}
#: Sides of dice in figures (fixed values).
DICE = ("4", "6", "8", "10", "12", "20", "100")
#: Nouns that a number counts, so that no dice are meant (fixed values).
COUNTED = "gardes joueurs soldats membres ans minutes secondes jours heures mètres personnages ennemis individus points".split()
#: Words of rolling dice (fixed values).
ROLLING = "lance lancer lances lancez lancent roule rouler roules roulez roulent tire tirer tires tirez tirent jet jets fait fais dégât dégâts dégat dégats degât degâts degat degats".split()
#: Words that what is heard as dice may not follow (fixed values).
EACH = ("chacun", "chacune")
#: How many words may stand between a word of rolling and the dice (a fixed value).
REACH = 3


def phonetic_terms(text: Column) -> Column:
    """What is heard for rolls and initiative in its usual spelling, and ``2 d 6`` as ``2d6``."""
    for plural in ("s", ""):
        roll = rf"(?iU)\bjet{plural}"
        text = F.regexp_replace(text, rf"{roll}\s*-\s*dés?\b", f"jet{plural} de dés")
        text = F.regexp_replace(text, rf"{roll}\s+de\s+délai\b", f"jet{plural} de dés")
        text = F.regexp_replace(text, rf"{roll}\s*d['’]\s*initiative\b", f"jet{plural} d'initiative")
    return F.regexp_replace(text, r"(?iU)\b(\d+)\s*d\s*(\d+)\b", "$1d$2")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), key)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def dice_notation(text: Column | str) -> Column:
    """``deux dés six`` becomes ``2d6`` where dice are meant; null for a null text.

    Tokens are what white space parts. Every token gets what a phrase of dice beginning there would be (``count``, die,
    perhaps ``de``, sides) and whether a word of rolling stands shortly before. The phrases are then taken from left to
    right: one counts if its die is written with an accent, or after a word of rolling, or after dice taken before; a
    phrase that doesn't count still covers its words.
    """
    number = "|".join([*COUNTS, r"[1-9]\d*"])
    sides = "|".join(sorted([*SIDES, *DICE], key=len, reverse=True))
    rolling = rf"(?iU)(?:^|\W)(?:{'|'.join(ROLLING)}|\d*d\d+)(?:-\w+)?$"

    def phrase(t: Column, i: Column) -> Column:
        """The phrase of dice that begins at a token: its number of tokens, notation, what stands before and after it."""
        at = lambda k: F.coalesce(F.get(t, i + k), F.lit(""))
        own = F.lower(F.regexp_extract(at(0), r"([^'’]*)$", 1))
        before = F.regexp_extract(at(0), r"^(.*['’])", 1)
        counted = own.rlike(rf"^(?:{number})$") & at(1).rlike("(?i)^d[éèe]s?$")
        die = F.when(counted, F.lower(at(1))).otherwise(own)
        first = F.when(counted, 2).otherwise(1)
        last = first + F.when(F.lower(at(first)) == "de", 1).otherwise(0)
        side = F.lower(F.regexp_extract(at(last), rf"(?iU)^({sides})\b", 1))
        after = F.substring(at(last), F.length(side) + 1, F.length(at(last)))
        blocked = before.rlike(r"(?i)\bl'$") | ((before == "") & F.lower(at(-1)).rlike(rf"(?U)(?:^|\W)(?:{'|'.join(EACH)})$"))
        thing = (after == "") & F.lower(at(last + 1)).rlike(rf"^(?:{'|'.join(COUNTED)})")
        meant = die.rlike("^d[éèe]s?$") & (counted | (die != "de")) & (side != "") & ~blocked & ~thing
        notation = F.concat(F.when(counted, _lookup(COUNTS, own)).otherwise(F.lit("1")), F.lit("d"), _lookup(SIDES, side))
        return F.when(meant, F.struct(i.alias("at"), (last + 1).alias("size"), F.concat(before, notation, after).alias("text"), die.rlike("[éè]").alias("sure"), (before != "").cast("int").alias("part"), (after == "").alias("open")))

    def context(t: Column, p: Column) -> Column:
        """How many tokens before a phrase hold no end of a sentence, and whether a word of rolling is near enough."""
        at = lambda k: F.coalesce(F.get(t, p["at"] - k), F.lit(""))
        clean = [F.when(~at(k).rlike("[.!?]"), 1).otherwise(0) for k in range(1, REACH + 2)]
        run, near = [F.lit(1)], []
        for k in range(1, REACH + 3):
            room = REACH - p["part"] + F.when(F.lower(at(k - 1)).isin("de", "d'", "d’") & at(k).rlike(r"(?iU)\bjets?$"), 1).otherwise(0) if k > 1 else REACH
            near.append((run[-1] == 1) & (F.lit(k - 1) <= room) & (p["at"] >= k) & at(k).rlike(rolling))
            if k <= REACH + 1:
                run.append(run[-1] * clean[k - 1])
        reach = F.array_max(F.array(*[F.when(r == 1, i).otherwise(0) for i, r in enumerate(run)]))
        heard = near[0]
        for x in near[1:]:
            heard = heard | x
        return F.struct(p["at"].alias("at"), p["size"].alias("size"), p["text"].alias("text"), (p["sure"] | heard).alias("sure"), F.least(F.lit(REACH) - p["part"], reach).alias("reach"), p["open"].alias("open"))

    # end: first token that no phrase covers; taken: end of the last phrase that counts, if no mark follows it
    start = F.struct(F.lit(0).alias("end"), F.lit(-99).alias("taken"), F.array().cast("array<struct<at:int,size:int,text:string>>").alias("kept"))

    def take(state: Column, p: Column) -> Column:
        counts = p["sure"] | (p["at"] - state["taken"] <= p["reach"])
        end = (p["at"] + p["size"]).cast("int")
        kept = F.when(counts, F.concat(state["kept"], F.array(F.struct(p["at"].cast("int").alias("at"), p["size"].cast("int").alias("size"), p["text"].alias("text"))))).otherwise(state["kept"])
        following = F.struct(end.alias("end"), F.when(counts & p["open"], end).when(counts, -99).otherwise(state["taken"]).alias("taken"), kept.alias("kept"))
        return F.when(p["at"] >= state["end"], following).otherwise(state)

    def kept(t: Column) -> Column:
        """The phrases that count among the tokens."""
        return _let(F.filter(F.transform(t, lambda _, i: phrase(t, i)), lambda p: p.isNotNull()), lambda found: F.aggregate(F.transform(found, lambda p: context(t, p)), start, take)["kept"])

    def written(pieces: Column, phrases: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            over = F.get(F.filter(phrases, lambda k: (k["at"] <= i) & (i < k["at"] + k["size"])), 0)
            return F.when(over.isNull(), piece).when(over["at"] == i, F.concat(F.regexp_extract(piece, r"(?U)^(\s*)", 1), over["text"])).otherwise(F.lit(""))

        return F.array_join(F.transform(pieces, one), "")

    def rewritten(whole: Column) -> Column:
        pieces = F.regexp_extract_all(whole, F.lit(r"(?U)\s*\S+"), F.lit(0))
        tokens = lambda p: F.transform(p, lambda x: F.regexp_replace(x, r"(?U)^\s+", ""))
        changed = _let(pieces, lambda p: _let(_let(tokens(p), kept), lambda phrases: written(p, phrases)))
        return F.concat(changed, F.regexp_extract(whole, r"(?U)(\s*)$", 1))

    # most texts hold nothing that could be dice
    maybe = rf"(?iU)(?:^|[\s'’])d[éèe]s?\s+(?:de\s+)?(?:{sides})\b"
    heard = phonetic_terms(F.col(text) if isinstance(text, str) else text)
    return _let(heard, lambda whole: F.when(whole.rlike(maybe), rewritten(whole)).otherwise(whole))
