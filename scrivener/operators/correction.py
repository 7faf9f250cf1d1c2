"""The correction cascade, set-based: whole values, then words, then characters.

Distinct values and words are corrected once, by joins, and joined back; what a reading
costs does not depend on how often it occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import similarity
from ..functions.text import collapse, like_case
from ..sources.sinks import kept
from .linkage import near_entry

#: How close a word, a whole value and the word before a city must come to an entry; the least length of half a word.
WORD_MATCH, VALUE_MATCH, BEFORE_CITY_MATCH, HALF = 0.8, 0.85, 0.7, 4


def nearest_or_same(words: DataFrame, entries: DataFrame, keys: Sequence[str], word: str, cutoff: float) -> DataFrame:
    """``words`` with ``found`` and ``found_score``: the entry itself (1.0) or the closest one, null if none is close."""
    near = near_entry(words, entries, keys, word, "entry", "weight", cutoff)
    exact = entries.select(*keys, F.upper("entry").alias("_e"), F.col("entry").alias("_same")).dropDuplicates([*keys, "_e"])
    both = near.withColumn("_e", F.upper(word)).join(exact, [*keys, "_e"], "left")
    return both.withColumn("found", F.coalesce("_same", "nearest")).withColumn("found_score", F.when(F.col("_same").isNotNull(), 1.0).otherwise(F.col("nearest_score"))).drop("_e", "_same", "nearest", "nearest_score")


def split_run_together(words: DataFrame, entries: DataFrame, keys: Sequence[str], word: str, cutoff: float = WORD_MATCH) -> DataFrame:
    """``keys, word, left, right`` of words that are two entries read as one, best worse half first (ties: the shorter left half).

    Each word gives its cuts, each half is looked up once; words without a cut give no row.
    """
    cuts = words.select(*keys, word).distinct().withColumn("_cut", F.explode(F.when(F.length(word) >= 2 * HALF, F.sequence(F.lit(HALF), F.length(word) - HALF))))
    halves = cuts.select(*keys, word, "_cut", F.substring(word, F.lit(1), F.col("_cut")).alias("l"), F.substring(word, F.col("_cut") + 1, F.length(word)).alias("r"))
    parts = halves.select(*keys, F.explode(F.array("l", "r")).alias("p")).distinct()
    known = nearest_or_same(parts, entries, keys, "p", cutoff).where("found is not null").select(*keys, "p", "found", "found_score")
    left, right = (known.select(*keys, F.col("p").alias(s), F.col("found").alias(f"{s}_found"), F.col("found_score").alias(f"{s}_score")) for s in "lr")
    scored = halves.join(left, [*keys, "l"]).join(right, [*keys, "r"]).withColumn("_s", F.least("l_score", "r_score"))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, word).orderBy(F.desc("_s"), "_cut"))).where("_n = 1")
    return best.select(*keys, word, F.col("l_found").alias("left"), F.col("r_found").alias("right"))


def is_city_like(word: Column, city: str, short: str | None = None) -> Column:
    """The city's name, its short form, or a close misreading of it."""
    w = F.upper(word)
    alike = F.startswith(w, F.lit(city)) | (similarity(w, F.lit(city)) >= WORD_MATCH)
    return F.coalesce(alike | (w == short) if short else alike, F.lit(False))


def is_city_run_together(word: Column, city: str, suffix: str = "CITY") -> Column:
    """A city's name with its suffix, or the suffix's first letter and up to three more, run onto it."""
    w = F.upper(word)
    n = len(city)
    fits = F.lit(False)
    for cut in range(n - 1, n + 2):
        rest = F.substring(w, F.lit(cut + 1), F.greatest(F.length(w), F.lit(1)))
        fits = fits | ((F.length(w) > cut) & rest.rlike(f"^{suffix[0]}[A-Z0-9]{{0,3}}$") & (similarity(F.substring(w, 1, cut), F.lit(city)) >= WORD_MATCH))
    return F.coalesce(fits, F.lit(False))


def reshape_code(c: Column, *, prefix: str | None, known: Sequence[str] = (), compact: bool = False, separator: str = "-") -> Column:
    """A code in the usual format: a first group that resembles the usual prefix becomes it, groups are joined as usual.

    Prefixes confirmed before are left alone; a code without groups stays as it is.
    """
    groups = F.filter(F.split(c, "[^0-9A-Za-z]+"), lambda g: g != "")
    n, first = F.size(groups), F.coalesce(F.get(groups, F.lit(0)), F.lit(""))
    rest = F.slice(groups, 2, F.greatest(n - 1, F.lit(0)))
    shaped = groups
    if prefix:
        odd = lambda part: (part != prefix) & ~part.isin(*known, prefix) & (similarity(F.upper(part), F.lit(prefix)) >= 0.5)
        head = F.substring(first, 1, 4)
        shaped = (
            F.when((n >= 2) & F.length(first).between(2, 5) & odd(first), F.array_prepend(rest, F.lit(prefix)))
            .when((n == 1) & (F.length(first) >= 6) & odd(head), F.array(F.concat(F.lit(prefix), F.substring(first, F.lit(5), F.length(first)))))
            .otherwise(groups)
        )
    return F.when(n > 0, F.array_join(shaped, "" if compact else separator)).otherwise(c)


def fix_characters(c: Column, pairs: dict[str, str], keep: str = "") -> Column:
    """Letters put right in columns of digits; those of ``keep`` stay."""
    used = {a: b for a, b in pairs.items() if a not in keep}
    return F.translate(c, "".join(used), "".join(used.values())) if used else c


def correct(df: DataFrame, keys: Sequence[str], text: str, name: str, *, values: DataFrame, words: DataFrame, entries: DataFrame) -> DataFrame:
    """``df`` with ``name``: the reading after the cascade, and ``name_by``: value, entry, words or none.

    ``values`` and ``words`` are corrections that reviews support (keys, ``wrong`` in
    capitals, ``correct``); ``entries`` is the vocabulary (keys, ``entry_type`` value or
    word, ``entry``, ``weight``). A whole value that reviews correct is taken; else an
    entry that is close to the whole value; else each word is corrected by reviews, by the
    closest entry, or by two entries that it runs together, in the case it is written in.
    Null and blank readings stay as they are.
    """
    row = "_reading"
    distinct = df.select(*keys, collapse(F.col(text)).alias(row)).where(f"{row} <> ''").distinct()
    whole = distinct.withColumn("wrong", F.upper(row)).join(values.select(*keys, "wrong", F.col("correct").alias("_v")), [*keys, "wrong"], "left").drop("wrong")
    near = kept(near_entry(whole, entries.where("entry_type = 'value'"), keys, row, "entry", "weight", VALUE_MATCH).drop("nearest_score"), "values")
    open_ = near.where("_v is null and nearest is null").select(*keys, row, F.posexplode(F.split(row, " ")).alias("_i", "_w"))
    vocabulary = entries.where("entry_type = 'word'")
    single = kept(open_.select(*keys, "_w").distinct().withColumn("wrong", F.upper("_w")).join(words.select(*keys, "wrong", F.col("correct").alias("_c")), [*keys, "wrong"], "left").drop("wrong"), "words")
    plain = F.col("_w").rlike(r"^\p{L}{3,}$") & F.col("_c").isNull()
    found = kept(nearest_or_same(single.where(plain), vocabulary, keys, "_w", WORD_MATCH).select(*keys, "_w", F.col("found").alias("_f")), "found")
    apart = split_run_together(found.where("_f is null"), vocabulary, keys, "_w").select(*keys, "_w", "left", "right")
    fixed = single.join(found, [*keys, "_w"], "left").join(apart, [*keys, "_w"], "left")
    cased = lambda c: like_case(F.col("_w"), F.col(c))
    fixed = fixed.select(*keys, "_w", F.coalesce("_c", cased("_f"), F.when(F.col("left").isNotNull(), F.concat(cased("left"), F.lit(" "), cased("right"))), "_w").alias("_x"))
    joined = open_.join(fixed, [*keys, "_w"]).groupBy(*keys, row).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]), " ").alias("_words"))
    done = near.join(joined, [*keys, row], "left")
    by = F.when(F.col("_v").isNotNull(), "value").when(F.col("nearest").isNotNull(), "entry").when(F.col("_words") != F.col(row), "words").otherwise("none")
    done = done.select(*keys, row, F.coalesce("_v", "nearest", "_words").alias(name), by.alias(f"{name}_by"))
    back = df.withColumn(row, collapse(F.col(text))).join(done, [*keys, row], "left")
    return back.withColumn(name, F.coalesce(name, F.col(text))).withColumn(f"{name}_by", F.coalesce(f"{name}_by", F.lit("none"))).drop(row)
