"""Person names as written in a register: parts, suffixes, newborns, sex and role."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import similarity
from .text import bound, collapse

#: Suffixes as written and as kept; words that belong to the word after them in a surname; spellings of newborn phrases.
SUFFIXES = {"JR": "JR", "JNR": "JR", "SR": "SR", "SNR": "SR", "II": "II", "III": "III", "IV": "IV", "2ND": "II", "3RD": "III", "4TH": "IV"}
PARTICLES = ("de", "dela", "del", "della", "delos", "delas", "la", "las", "los", "le", "san", "santa", "sto", "sta", "mac", "mc", "van", "von", "di", "da", "du")
BABY = ("BABY", "BBY", "BB", "BABE", "BAEY", "BABV", "BAHY", "BAB", "BABI", "BBAY", "BAYB")
GIRL = ("GIRL", "GRL", "GIRI", "GURL", "GRIL", "GIRLL", "GIR", "GIRK", "CIRL", "GLRL", "GIRT")
BOY = ("BOY", "BOI", "BOYY", "BQY", "BOV", "B0Y", "BUY")
#: Signs and digits read for letters in newborn phrases (13 is read for B), and how close to BABY an unknown spelling must be.
NEWBORN_FROM, NEWBORN_TO = "018|!", "OIBII"
BABY_CUTOFF = 0.75


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.upper(word), "[.,]", "")


def suffix_of(word: Column) -> Column:
    """The suffix that a word is, as it is kept; null if it is none."""

    def named(bare: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for kept in dict.fromkeys(SUFFIXES.values()):
            out = out.when(bare.isin(*[k for k, v in SUFFIXES.items() if v == kept]), kept)
        return out

    return bound(_bare(word), named)


def name_units(words: Column) -> Column:
    """Words of a name with particles joined to what follows them."""
    particle = lambda w: F.lower(F.regexp_replace(w, r"\.", "")).isin(*PARTICLES)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, w: Column) -> Column:
        grown = F.when(acc["open"] == "", w).otherwise(F.concat(acc["open"], F.lit(" "), w))
        return F.when(particle(w), F.struct(acc["done"].alias("done"), grown.alias("open"))).otherwise(F.struct(F.array_append(acc["done"], grown).alias("done"), F.lit("").alias("open")))

    return F.aggregate(words, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def split_name(c: Column) -> Column:
    """Struct (last, first, middle, suffix, guessed) of a free-text name.

    ``LAST, FIRST MIDDLE`` is taken as written; without a comma the last unit is the last
    name and the order is a guess. With three or more given units the last is the middle
    name, with two the second, and a suffix is taken off wherever it stands. Blank: nulls.
    """
    cut = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    said = lambda ws: F.transform(ws, suffix_of)
    ends = lambda ws, said: F.when(F.size(ws) > 1, F.element_at(said, -1))
    shed = lambda ws, said: F.when(ends(ws, said).isNotNull(), F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0)))).otherwise(ws)

    # each step is bound, so that what later ones use several times is found once a name
    def words(t: Column) -> Column:
        comma = F.contains(t, F.lit(","))
        before = F.when(comma, F.trim(F.substring_index(t, ",", 1))).otherwise(t)
        after = F.when(comma, F.trim(F.regexp_replace(F.regexp_replace(t, "^[^,]*,", ""), ",", " "))).otherwise(F.lit(""))
        return bound(F.struct(t.alias("t"), comma.alias("comma"), cut(before).alias("whole"), cut(after).alias("after")), suffixes)

    def suffixes(x: Column) -> Column:
        return bound(F.struct(x.alias("x"), said(x["whole"]).alias("whole"), said(x["after"]).alias("after")), lambda s: order(s["x"], s["whole"], s["after"]))

    def order(x: Column, whole: Column, after: Column) -> Column:
        only_suffix = x["comma"] & (F.size(x["after"]) > 0) & F.forall(after, lambda s: s.isNotNull())
        suffix = F.coalesce(F.when(only_suffix, F.get(after, F.lit(0))), ends(x["whole"], whole), F.when(x["comma"], ends(x["after"], after)))
        found = F.struct(x["t"].alias("t"), (~x["comma"] | only_suffix).alias("plain"), shed(x["whole"], whole).alias("whole"), shed(x["after"], after).alias("after"), suffix.alias("suffix"))
        return bound(found, lambda o: bound(name_units(F.when(o["plain"], o["whole"]).otherwise(o["after"])), lambda units: parts(o, units)))

    def parts(o: Column, units: Column) -> Column:
        n = F.when(o["plain"], F.greatest(F.size(units) - 1, F.lit(0))).otherwise(F.size(units))  # given units
        given = F.slice(units, 1, n)
        first = F.when(n == 0, None).when(n == 1, F.get(units, F.lit(0))).otherwise(F.array_join(F.slice(given, 1, F.greatest(n - 1, F.lit(1))), " "))
        middle = F.when(n >= 2, F.get(units, n - 1))
        last = F.when(o["plain"], F.when(F.size(units) > 0, F.element_at(units, F.greatest(F.size(units), F.lit(1))))).otherwise(F.nullif(F.array_join(o["whole"], " "), F.lit("")))
        filled = F.coalesce(o["t"], F.lit("")) != ""
        return F.struct(*[F.when(filled, x).alias(a) for x, a in ((last, "last"), (first, "first"), (middle, "middle"), (o["suffix"], "suffix"))], (filled & o["plain"] & (F.size(units) != 1)).alias("guessed"))

    return bound(collapse(c), words)


def _newborn_words(part: Column) -> Column:
    """Struct (phrase, words that say it) for the first words of a part of a name; null if they say none."""
    words = F.filter(F.split(collapse(part), " "), lambda w: w != "")
    fold = lambda i: F.translate(F.replace(F.regexp_replace(F.upper(F.get(words, F.lit(i))), "[^A-Z0-9|!]", ""), F.lit("13"), F.lit("B")), NEWBORN_FROM, NEWBORN_TO)
    girls, boys = ([w.replace("0", "O") for w in ws] for ws in (GIRL, BOY))
    first, second, out = fold(0), fold(1), F.lit(None).cast("struct<phrase: string, words: int>")
    unsure = F.when((F.length(first) >= 4) & second.isin(*girls, *boys), first)
    baby = first.isin(*BABY) | F.coalesce(similarity(F.lit("BABY"), unsure) >= BABY_CUTOFF, F.lit(False))
    for phrase, ws in (("BABY BOY", boys), ("BABY GIRL", girls)):
        glued = first.rlike(rf"^(?:{'|'.join(BABY)})(?:{'|'.join(ws)})$")
        say = lambda n: F.struct(F.lit(phrase).alias("phrase"), F.lit(n).alias("words"))  # noqa: B023, E731
        out = F.when(glued, say(1)).when(baby & second.isin(*ws), say(2)).otherwise(out)
    return out


def newborn(c: Column) -> Column:
    """``BABY GIRL`` or ``BABY BOY`` if a name says so where it starts or after its first comma, read with look-alike digits; else null.

    A first word that is no known spelling counts if it has four letters or more, is close
    enough to BABY, and the second word is a known spelling.
    """
    return F.coalesce(_newborn_words(_after_comma(c))["phrase"], _newborn_words(F.substring_index(c, ",", 1))["phrase"])


def _after_comma(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(",")), F.regexp_replace(c, "^[^,]*,", ""))


def clean_newborn(c: Column) -> Column:
    """The name with its newborn phrase, after the comma if there is one, written properly; any other name as it was."""
    given = _after_comma(c)
    part = F.coalesce(given, c)

    def said(found: Column) -> Column:
        words = F.filter(F.split(collapse(part), " "), lambda w: w != "")
        whole = F.concat_ws(" ", found["phrase"], F.slice(words, found["words"] + 1, F.greatest(F.size(words), F.lit(1))))
        return F.when(found.isNull(), c).when(given.isNotNull(), F.concat(F.trim(F.substring_index(c, ",", 1)), F.lit(", "), whole)).otherwise(whole)

    return F.element_at(F.transform(F.array(_newborn_words(part)), said), 1)


def restore_enye(c: Column, known: dict[str, str]) -> Column:
    """Words written with N where a known name has Ñ, put right; ``known`` maps the plain form to the right one."""
    if not known:
        return c
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.element_at(names, F.upper(w)), w)), " ")
