"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import WORD, staged

#: No source is taken more often than this.
MAX_REPEATS = 3
#: Words of a budget that are fitted by dynamic programming at first, and at most where no sum meets the budget.
DP_WORDS, MOST_DP_WORDS = 1 << 17, 1 << 22
#: A (source, size) group of more documents is ranked in as many hash buckets as it takes, so that no task ranks a whole hot group.
RANKED = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_turns(*weights: float) -> Callable[[Column], Column]:
    """Weights dealt out to the sources in code-point order, again and again."""
    return lambda place: F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weigh: Callable[[Column], Column], *, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``_key, source_size, target`` from ``_key, size`` rows.

    ``share`` of the total is dealt out by weight; a source's target stops at
    ``max_repeats`` times its size and the excess goes to the others by weight, until none
    is above. Each round of that is one aggregate over the sources; only sums reach the
    driver, and no task sees all sources.
    """
    per = numbered(sizes.groupBy("_key").agg(F.sum("size").alias("source_size")), [F.col("_key")], "_place")
    per = staged(per.select("_key", "source_size", weigh(F.col("_place")).alias("_w"), (F.col("source_size") * float(max_repeats)).alias("_cap")), "sources")
    level, capped = 0.0, -1
    while True:
        over = F.col("_cap") <= level * F.col("_w")
        n, total, held, weight = per.agg(F.count_if(over), F.sum("source_size") * share, F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w")))).first()
        if n == capped or not weight:
            break
        level, capped = ((total or 0) - (held or 0.0)) / weight, n
    return per.select("_key", "source_size", F.least(F.col("_cap"), F.col("_w") * level).alias("target"))


def _prefilled(sizes: np.ndarray, counts: np.ndarray, budget: int, words: int) -> np.ndarray:
    """Documents of each size that are taken without a search, so that about ``words`` of the budget are left to it.

    The same share of every size, then whole documents from the largest size down; of each
    size some are given back, so that the search may do without them.
    """
    taken = np.zeros(len(sizes), np.int64)
    if budget <= words:
        return taken
    total = int((sizes * counts).sum())
    taken = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    rest = budget - int((taken * sizes).sum())
    for i in np.argsort(-sizes, kind="stable").tolist():
        if rest <= words // 2:
            break
        n = min(int(counts[i] - taken[i]), (rest - words // 4) // int(sizes[i]))
        taken[i] += max(n, 0)
        rest -= max(n, 0) * int(sizes[i])
    each = words // 2 // len(sizes)
    for i in np.argsort(sizes, kind="stable").tolist():
        n = min(int(taken[i]), max(1, each // int(sizes[i])))
        if rest + n * int(sizes[i]) <= words:
            taken[i] -= n
            rest += n * int(sizes[i])
    return taken


def _nearest_sum(sizes: np.ndarray, counts: np.ndarray, rest: int) -> tuple[np.ndarray, int]:
    """Bounded knapsack: documents of each size whose sum is as near to ``rest`` as any, and how far it is.

    Dynamic programming on the set of reachable sums, a bit each, in units of the sizes'
    common divisor; of equals the lower sum. Of n steps only the sets at every sqrt(n)-th are
    kept; going back, those between are made again.
    """
    unit = int(np.gcd.reduce(sizes)) if len(sizes) else 1
    low, above = divmod(rest, unit)
    best = low if 2 * above <= unit else low + 1  # the nearest multiple, if it can be reached
    most = 2 * low + 1  # a sum further above than that is further away than taking nothing
    mask, steps = (1 << (most + 1)) - 1, []
    for i in np.argsort(sizes, kind="stable").tolist():
        s, n = int(sizes[i]) // unit, 1
        left = min(int(counts[i]), most // s)
        while left > 0:  # counts in binary parts
            n = min(n, left)
            steps.append((i, n, n * s))
            left -= n
            n *= 2
    every = max(1, math.isqrt(len(steps)))
    reach, kept = 1, []
    for k, (_, _, size) in enumerate(steps):
        if k % every == 0:
            kept.append(reach)
        if reach >> best & 1:
            del steps[k:]
            break
        reach |= (reach << size) & mask
    goal = (reach & ((1 << (low + 1)) - 1)).bit_length() - 1
    if over := reach >> (low + 1):
        higher = low + (over & -over).bit_length()
        goal = higher if higher * unit - rest < rest - goal * unit else goal
    off, taken = abs(goal * unit - rest), np.zeros(len(sizes), np.int64)
    for first in range((len(steps) - 1) // every * every if steps else -1, -1, -every):
        between = [kept[first // every]]
        for _, _, size in steps[first : first + every - 1]:
            between.append(between[-1] | (between[-1] << size) & mask)
        for (i, n, size), without in zip(reversed(steps[first : first + every]), reversed(between[: len(steps) - first])):
            if not without >> goal & 1:
                taken[i] += n
                goal -= size
    return taken, off


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to ``budget`` or as near to it as can be.

    Budgets up to ``dp_words`` are a bounded knapsack as a whole, so the nearest sum is
    found. Of larger ones all but about ``dp_words`` is taken in proportion first; where
    the search then meets no exact sum, it is repeated with four times the words, up to
    the whole budget or ``MOST_DP_WORDS``.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    out, some = np.zeros(len(sizes), np.int64), np.flatnonzero((sizes > 0) & (counts > 0))
    s, c = sizes[some], counts[some]
    budget = min(int(budget), int((s * c).sum()))
    if budget <= 0:
        return out
    unit = int(np.gcd.reduce(s))
    least = min(budget % unit, -budget % unit)
    while True:
        taken = _prefilled(s, c, budget, dp_words)
        more, off = _nearest_sum(s, c - taken, budget - int((taken * s).sum()))
        if off <= least or not taken.any() or dp_words >= MOST_DP_WORDS:
            out[some] = taken + more
            return out
        dp_words = min(4 * dp_words, MOST_DP_WORDS)


def mix(docs: DataFrame, weigh: Callable[[Column], Column], *, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``key, source, size, source_size, target, copies`` for each row of ``docs``.

    ``size`` is the number of words (null text: 0). A source with target t is taken whole
    t div source_size times; what is missing is fitted by :func:`fit_budget` over its
    counts of documents by exact size, and of each size the documents that come first in
    a seeded hash order are taken once more. So copies are at most ``max_repeats`` and
    reruns agree. A null source is a source, last in order. Ties of the hash (repeated
    keys) are rows that differ in nothing that counts here. An empty table, or one with
    no words, gives no copies.

    Texts are read once, for their sizes; all that is shuffled is keys and counts. A
    (source, size) group of over ``RANKED`` documents is ranked in hash buckets whose
    counts say where each begins, so a hot group is spread over many tasks, and what is
    counted by bucket grows with the large groups only.
    """
    named = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    h = F.xxhash64(F.lit(seed), F.col(key))
    base = docs.select(F.col(key).alias("_id"), F.col(source).alias("_source"), named.alias("_key"), word_count(F.col(text)).alias("size"), h.alias("_h"))
    base = staged(base, "sizes")
    lengths = staged(base.groupBy("_key", "size").agg(F.count("*").alias("n")), "counts")
    targets = staged(source_targets(lengths.select("_key", (F.col("size") * F.col("n")).alias("size")), weigh, share=share, max_repeats=max_repeats), "targets")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        target, whole = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
        rounds = min(int(round(target)) // whole, max_repeats) if whole else 0
        rest = int(round(target)) - rounds * whole if rounds < max_repeats else 0
        pdf = pdf.sort_values("size")
        more = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), rest)
        return pd.DataFrame({"_key": pdf["_key"], "size": pdf["size"], "n": pdf["n"], "_rounds": rounds, "_more": more, "source_size": whole, "target": target})

    plans = lengths.join(targets, "_key").groupBy("_key").applyInPandas(plan, "_key string, size long, n long, _rounds long, _more long, source_size long, target double")
    plans = staged(plans.withColumn("_buckets", F.ceil(F.col("n") / RANKED)).drop("n"), "plans")
    # ranges of the hash, so that places do not depend on their number
    bucket = F.floor((F.col("_h") / float(1 << 64) + 0.5) * F.col("_buckets"))
    dealt = base.join(plans, ["_key", "size"]).withColumn("_bucket", bucket)
    ahead = Window.partitionBy("_key", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    large = base.join(plans.where("_buckets > 1").select("_key", "size", "_buckets"), ["_key", "size"]).groupBy("_key", "size", bucket.alias("_bucket")).count()
    starts = large.select("_key", "size", "_bucket", F.sum("count").over(ahead).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_key", "size", "_bucket").orderBy("_h"))
    ranked = dealt.join(starts, ["_key", "size", "_bucket"], "left").withColumn("_place", F.coalesce("_start", F.lit(0)) + place)
    copies = F.col("_rounds") + F.when((F.col("_place") <= F.col("_more")) & (F.col("size") > 0), 1).otherwise(0)
    return ranked.select(F.col("_id").alias(key), F.col("_source").alias(source), "size", "source_size", "target", copies.cast("int").alias("copies"))
