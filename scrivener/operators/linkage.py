"""Record linkage by blocks: score joins, near matches, leakage filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import similarity
from ..sources.sinks import kept
from .signatures import similar_pairs


def blocked_pairs(left: DataFrame, right: DataFrame, a: str, b: str, blocks: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Distinct pairs of ids (``a``, ``b``) that agree on at least one block key, others being null or unlike.

    Each block is an equi-join on its key alone, so the work follows the pairs that agree;
    pick keys that are selective, and split a frequent one by a further column.
    """
    out = None
    for left_key, right_key in blocks:
        one = left.select(a, left_key.alias("_b")).where("_b is not null").join(right.select(b, right_key.alias("_b")).where("_b is not null"), "_b").select(a, b)
        out = one if out is None else out.union(one)
    return out.distinct()


def scored_links(left: DataFrame, right: DataFrame, a: str, b: str, blocks: Sequence[tuple[Column, Column]], points: Sequence[tuple[str, int]]) -> DataFrame:
    """Candidate pairs with the sum of the points whose SQL condition holds; pairs without points are left out.

    Every condition that gives points must imply agreement on some block, or links are lost.
    """
    pairs = blocked_pairs(left, right, a, b, blocks).join(left, a).join(right, b)
    score = sum((F.when(F.coalesce(F.expr(cond), F.lit(False)), n).otherwise(0) for cond, n in points), F.lit(0))
    return pairs.withColumn("score", score).where("score > 0")


def near_entry(readings: DataFrame, entries: DataFrame, keys: Sequence[str], text: str, entry: str, weight: str, cutoff: float, *, band: bool = True) -> DataFrame:
    """``readings`` with the entry of their key that is closest, at least ``cutoff``, ties going to the heavier and then the smaller.

    A reading that is an entry itself gets none. With ``band``, a rule of the correction cascade, only entries
    whose length is within max(2, a quarter) count; without it every entry that comes to ``cutoff`` does.
    Candidates come from an equi-join on signatures (:func:`.signatures.similar_pairs`), and letters in common
    bound the similarity of those before it is taken.
    """
    from pyspark.sql import Window

    named = kept(entries.select(*keys, F.upper(entry).alias("_e"), F.col(entry).alias("_shown"), F.col(weight).alias("_w")), "entries")
    distinct = kept(readings.select(*keys, F.upper(text).alias("_t")).distinct(), "readings")
    known = distinct.join(named.select(*keys, F.col("_e").alias("_t")), [*keys, "_t"], "left_semi")
    asked = distinct.join(known, [*keys, "_t"], "left_anti")
    apart = F.greatest(F.lit(2), F.floor(F.col("size") / 4))
    pairs = similar_pairs(asked, named, keys, "_t", "_e", cutoff, (F.col("size") - apart, F.col("size") + apart) if band else None)
    # letters in common bound the similarity from above, without leaving the JVM
    holds = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split("_t", "")), F.lit(0), lambda a, c: a + F.least(holds(F.col("_t"), c), holds(F.col("_e"), c)))
    scored = pairs.where(2 * common >= cutoff * (F.length("_t") + F.length("_e"))).withColumn("_s", similarity(F.col("_t"), F.col("_e"))).where(F.col("_s") >= cutoff).join(named, [*keys, "_e"])
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(F.desc("_s"), F.desc("_w"), "_e"))).where("_r = 1")
    best = kept(best.select(*keys, "_t", F.col("_shown").alias("nearest"), F.col("_s").alias("nearest_score")), "nearest")
    return readings.withColumn("_t", F.upper(text)).join(best, [*keys, "_t"], "left").drop("_t")


def surname_match(a: Column, b: Column) -> Column:
    """Equal, one within the other, or similar by 0.8; false for blanks."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | (similarity(x, y) >= 0.8)), F.lit(False))
