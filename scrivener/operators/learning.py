"""Learning from reviewed readings: counts, supported modes, votes, formats, corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, edges

#: A correction is used only when seen at least this often, and for this share of what was seen.
MIN_SEEN, MIN_SHARE = 2, 0.6


def supported_mode(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n", *, least: float = MIN_SEEN, share: float = MIN_SHARE) -> DataFrame:
    """The most frequent value of each key with its count and the ``total``, where both suffice; ties go to the smaller value.

    One aggregate; unchanged values belong in ``counts``, where they outvote corrections.
    """
    got = counts.groupBy(*keys).agg(F.min_by(F.struct(value, n), F.struct((-F.col(n)).alias("m"), F.col(value))).alias("_b"), F.sum(n).alias("total"))
    ok = (F.col("total") >= least) & (F.col(f"_b.{n}") / F.col("total") >= share)
    return got.where(ok).select(*keys, f"_b.{value}", f"_b.{n}", "total")


def weighted_vote(readings: DataFrame, keys: Sequence[str], text: str, confidence: str) -> DataFrame:
    """Per key the reading with the greatest summed confidence: ``key`` (capitals), ``text`` as best read, ``votes``, ``score``, ``mean_confidence``.

    Readings that differ in case only are one; ties go to more votes, then the smaller key.
    Blank and null readings do not vote.
    """
    clean = readings.where(F.trim(F.col(text)) != "").withColumn("_t", collapse(F.col(text)))
    groups = clean.groupBy(*keys, F.upper("_t").alias("key")).agg(F.sum(confidence).alias("score"), F.count("*").alias("votes"), F.max_by("_t", F.struct(confidence, "_t")).alias("text"))
    best = groups.groupBy(*keys).agg(F.min_by(F.struct("key", "text", "votes", "score"), F.struct((-F.col("score")).alias("s"), (-F.col("votes")).alias("v"), "key")).alias("_b"))
    return best.select(*keys, "_b.key", "_b.text", "_b.votes", "_b.score", (F.col("_b.score") / F.col("_b.votes")).alias("mean_confidence"))


def format_profile(df: DataFrame, keys: Sequence[str], code: str, *, prefix: int = 4) -> DataFrame:
    """Usual shape of codes: ``total``, how many are ``compact`` (no separators), and the commonest ``prefix`` (ties: the greater)."""
    shaped = df.withColumn("_p", F.substring(code, 1, prefix)).withColumn("_compact", F.col(code).rlike("^[0-9A-Za-z]+$"))
    by_prefix = shaped.groupBy(*keys, "_p").agg(F.count("*").alias("n"), F.count_if("_compact").alias("c"))
    return by_prefix.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("c").alias("compact"), F.max_by("_p", F.struct("n", "_p")).alias("prefix"))


def word_patterns(df: DataFrame, keys: Sequence[str], raw: str, final: str) -> DataFrame:
    """Word corrections (``wrong`` in capitals, ``correct``, ``n``) of readings whose words pair off one to one, unchanged words included."""
    split = lambda c: F.transform(F.split(collapse(F.col(c)), " "), lambda w: edges(w)["core"])
    paired = df.withColumn("_a", split(raw)).withColumn("_b", split(final)).where(F.size("_a") == F.size("_b"))
    rows = paired.select(*keys, F.inline(F.arrays_zip(F.transform("_a", F.upper).alias("wrong"), F.col("_b").alias("correct")))).toDF(*keys, "wrong", "correct")
    return rows.where("wrong <> '' and correct <> ''").groupBy(*keys, "wrong", "correct").agg(F.count("*").alias("n"))


def correct_words(df: DataFrame, keys: Sequence[str], raw: Column, corrections: DataFrame, name: str) -> DataFrame:
    """``name``: the reading with each word replaced as ``corrections`` (keys, wrong, correct) say.

    Each distinct reading of a key is taken apart once and its words are joined to the
    corrections; a word with several gets the smallest. Null readings and keys stay.
    """
    one = corrections.groupBy(*keys, "wrong").agg(F.min("correct").alias("_c"))
    whole = df.withColumn("_t", collapse(raw))
    texts = whole.select(*keys, "_t").where("_t is not null").distinct()
    words = texts.select(*keys, "_t", F.posexplode(F.split("_t", " ")).alias("_i", "_w")).withColumn("wrong", F.upper("_w"))
    fixed = words.join(one, [*keys, "wrong"], "left").groupBy(*keys, "_t").agg(F.sort_array(F.collect_list(F.struct("_i", F.coalesce("_c", "_w").alias("w")))).alias("_ws"))
    done = fixed.select(*keys, "_t", F.array_join(F.transform("_ws", lambda x: x["w"]), " ").alias("_fixed"))
    return whole.join(done, [*keys, "_t"], "left").select(*df.columns, F.coalesce("_fixed", "_t").alias(name))


def entries(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Vocabulary candidates: the words of three or more letters, and the whole value, counted: ``entry_type, entry_key, shown, n``."""
    whole = F.struct(F.lit("value").alias("entry_type"), collapse(F.col(text)).alias("shown"))
    words = F.transform(F.filter(F.transform(F.split(collapse(F.col(text)), " "), lambda w: edges(w)["core"]), lambda w: w.rlike(r"^\p{L}{3,}$")), lambda w: F.struct(F.lit("word").alias("entry_type"), w.alias("shown")))
    rows = df.where(F.trim(F.col(text)) != "").select(*keys, F.inline(F.concat(F.array(whole), words)))
    return rows.groupBy(*keys, "entry_type", F.upper("shown").alias("entry_key")).agg(F.max("shown").alias("shown"), F.count("*").alias("n"))
