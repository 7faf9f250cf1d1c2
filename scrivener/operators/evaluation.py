"""Evaluation of readings and rules: summaries with totals, bands, sweeps, confusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import char_accuracy, f1, percent, ratio


def with_total(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], *, total: str = "All") -> DataFrame:
    """Aggregates by ``keys`` and over everything, in one pass; the total row has ``total`` in each key."""
    rolled = df.withColumn("_k", F.struct(*keys)).rollup("_k").agg(*aggregates, F.grouping("_k").alias("_all"))
    return rolled.select(*[F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(f"_k.{k}")).alias(k) for k in keys], *[c for c in rolled.columns if c not in ("_k", "_all")])


def judge(truth: Column, raw: Column, corrected: Column) -> Column:
    """What a correction did: unchanged, helpful, harmful or still wrong; null if nothing was read."""
    return (
        F.when(raw.isNull() | corrected.isNull(), None).when(raw == corrected, "unchanged").when(corrected == truth, "helpful").when(raw == truth, "harmful").otherwise("still_wrong")
    )


def correction_metrics(df: DataFrame, keys: Sequence[str], judged: str = "judged") -> DataFrame:
    """Counts of changes by kind, precision (helpful / changes) and harmful rate."""
    n = lambda kind: F.count_if(F.col(judged) == kind)
    out = df.where(F.col(judged).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(judged) != "unchanged").alias("changes"), n("helpful").alias("helpful"), n("harmful").alias("harmful"))
    return out.withColumn("precision", ratio(F.col("helpful"), F.col("changes"))).withColumn("harmful_rate", ratio(F.col("harmful"), F.col("changes")))


def prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Precision, recall and F1 from count columns."""
    out = df.withColumn("precision", ratio(F.col(tp), F.col(tp) + F.col(fp))).withColumn("recall", ratio(F.col(tp), F.col(tp) + F.col(fn)))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def band(value: Column, edges: Sequence[float], none: str = "no reading") -> Column:
    """Label of the half-open band of ``edges`` that holds a value; open at both ends; ``none`` for null."""
    out = F.when(value.isNull(), none).when(value < edges[0], f"< {edges[0]}")
    for a, b in zip(edges, edges[1:]):
        out = out.when(value < b, f"{a} - {b}")
    return out.otherwise(f">= {edges[-1]}")


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], confidence: Column, wrong: Column) -> DataFrame:
    """Rows accepted at each threshold, how many of them are wrong, and their share.

    One aggregate with a pair of conditional counts a threshold, unpivoted; the table is
    neither repeated nor joined.
    """
    counted = df.agg(*[F.struct(F.count_if(confidence >= x).alias("accepted"), F.count_if((confidence >= x) & wrong).alias("wrong")).alias(f"_{i}") for i, x in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"_{i}.accepted").alias("accepted"), F.col(f"_{i}.wrong").alias("wrong")) for i, x in enumerate(thresholds)])
    return counted.select(F.inline(rows)).withColumn("wrong_percent", percent(F.col("wrong"), F.col("accepted")))


def variant_accuracy(truth: Column, variants: Sequence[str]) -> list[Column]:
    """Aggregates ``exact_*`` and ``accuracy_*`` (percent) of each variant's readings; what was not read does not count."""
    out = []
    for v in variants:
        out.append(percent(F.count_if(F.col(v) == truth), F.count(v)).alias(f"exact_{v}"))
        out.append(F.avg(F.when(F.col(v).isNotNull(), char_accuracy(truth, F.col(v)))).alias(f"accuracy_{v}"))
    return out


def cut_verdict(truth: Column, reading: Column, best_other: Column, own: Column, *, margin: float, least: float, clear: float = 75.0) -> Column:
    """Whether a cut holds its own field's text: right, wrong (another's fits better), unsure, or for a blank field clean, stray marks or writing."""
    read = F.length(F.regexp_replace(F.coalesce(reading, F.lit("")), "[^A-Za-z0-9]", "")) >= 2
    other = F.coalesce(best_other, F.lit(0.0))
    blank = F.when(~read, "blank").when(other >= clear, "writing in a blank").otherwise("stray marks")
    return (
        F.when(F.coalesce(truth, F.lit("")) == "", blank).when(~read, "unsure").when((other >= clear) & (other > own + margin), "wrong")
        .when((own >= least) & (best_other.isNull() | (own >= other)), "right").otherwise("unsure")
    )


def alignment(key: DataFrame, found: DataFrame, page: str, row: str, score) -> DataFrame:
    """Rows of an answer key beside the rows found, full outer: ``status, here, above, below``.

    ``score(truth, text)`` compares; a row whose neighbour's text fits clearly better is
    called shifted. Rows found but not in the key are told apart.
    """
    texts = [found.select(page, (F.col(row) + d).alias(row), F.col("text").alias(name)) for d, name in ((0, "_here"), (1, "_above"), (-1, "_below"))]
    both = key.join(texts[0], [page, row], "full").join(texts[1], [page, row], "left").join(texts[2], [page, row], "left")
    here, above, below = (F.when(F.col("truth").isNotNull(), score(F.col("truth"), F.col(c))) for c in ("_here", "_above", "_below"))
    scored = both.select(page, row, F.col("truth").isNull().alias("_extra"), F.col("_here").isNull().alias("_none"), here.alias("here"), above.alias("above"), below.alias("below"))
    best = F.greatest("above", "below")
    fits = best.isNull() | (F.col("here") >= best - 10) | (F.col("here") >= 60)
    status = F.when(F.col("_extra"), "found, not in key").when(F.col("_none"), "not detected").when(F.col("here").isNull(), "no text").when(fits, "aligned").otherwise("shifted")
    return scored.select(page, row, status.alias("status"), "here", "above", "below")


def set_score(fired: Column, required: Column, allowed: Column) -> Column:
    """Struct of sets: hits, misses and false alarms (what is merely allowed is no alarm)."""
    return F.struct(
        F.array_intersect(fired, required).alias("tp"), F.array_except(required, fired).alias("fn"), F.array_except(F.array_except(fired, required), allowed).alias("fp")
    )


def reduction(before: Column, after: Column) -> Column:
    """Percent less than before; null if that was 0."""
    return percent(before - after, before)


def pivot_difference(df: DataFrame, keys: Sequence[str], by: str, values: tuple[str, str], measure: Column, name: str = "difference") -> DataFrame:
    """A measure for two values of ``by`` side by side, and second less first."""
    a, b = values
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(by) == v, measure)).alias(v) for v in values]).withColumn(name, F.col(b) - F.col(a))
