"""Mergeable partial aggregates: sketches kept by part, merged for any range of parts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the buckets of distinct counts (standard error 1.04 / sqrt(buckets), about 1.6 %), and the size of quantile sketches (rank error about 1.3 %).
DISTINCT_BITS, QUANTILE_K = 12, 200
#: Counters of frequent items: counts are too low by at most (rows / counters).
COUNTERS = 256


@dataclass(frozen=True)
class Sketches:
    """What is kept of each group and part: rows, sum, distinct values, quantiles and frequent items.

    ``distinct`` is any column, ``number`` a numeric one, ``item`` one of strings. Nulls
    are in none but the row count.
    """

    distinct: str
    number: str
    item: str
    bits: int = DISTINCT_BITS
    k: int = QUANTILE_K
    counters: int = COUNTERS

    def partial(self, df: DataFrame, keys: Sequence[str], part: Column) -> DataFrame:
        """``keys, part, n, total, distinct, quantiles, frequent``: one row a group and part, to be stored and added to.

        Frequent items are counted exactly within a part by one aggregate, then cut to the
        ``counters`` greatest, each lowered by the first that is left out (``slack``), so sums over parts
        are never too high, and too low by at most the sum of the slacks.
        """
        parted = df.withColumn("part", part)
        value, number = F.col(self.distinct), F.col(self.number).cast("double")
        sketch = parted.groupBy(*keys, "part").agg(
            F.count("*").alias("n"), F.sum(F.col(self.number).cast("decimal(28,2)")).cast("decimal(38,2)").alias("total"),
            F.hll_sketch_agg(value.cast("string"), self.bits).alias("distinct"), F.kll_sketch_agg_double(number, self.k).alias("quantiles"),
        )
        return sketch.join(self._frequent(parted, [*keys, "part"]), [*keys, "part"], "left")

    def _frequent(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        counted = df.where(F.col(self.item).isNotNull()).groupBy(*keys, F.col(self.item).alias("_item")).agg(F.count("*").alias("c"))
        return self._cut(counted, keys, F.lit(0).cast("long"))

    def _cut(self, counted: DataFrame, keys: Sequence[str], slack: Column) -> DataFrame:
        """The ``counters`` greatest counts of each group in two steps: within buckets of items, then of the group, so no task sorts all items of a hot one."""
        from pyspark.sql import Window

        first = counted.withColumn("_s", slack).withColumn("_bucket", F.pmod(F.xxhash64("_item"), F.lit(64)))
        for by in ([*keys, "_bucket"], list(keys)):
            w = Window.partitionBy(*by).orderBy(F.desc("c"), "_item")
            first = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= self.counters + 1)
        over = F.coalesce(F.max(F.when(F.col("_r") == self.counters + 1, F.col("c"))), F.lit(0))
        listed = first.groupBy(*keys).agg(F.collect_list(F.when(F.col("_r") <= self.counters, F.struct("_item", "c"))).alias("_l"), over.alias("_o"), F.max("_s").alias("_s"))
        kept = F.filter(F.transform("_l", lambda x: F.struct(x["_item"].alias("item"), (x["c"] - F.col("_o")).alias("count"))), lambda x: x["count"] > 0)
        return listed.select(*keys, F.struct(F.array_sort(kept).alias("items"), (F.col("_o") + F.col("_s")).alias("slack")).alias("frequent"))

    def merged(self, partial: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Sketches of ``keys`` over all rows of ``partial`` (pick a range of parts before): the same columns without ``part``."""
        both = partial.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,2)").alias("total"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.sum(F.coalesce("frequent.slack", F.lit(0))).alias("_slack"))
        items = partial.select(*keys, F.explode("frequent.items").alias("_x")).groupBy(*keys, F.col("_x.item").alias("_item")).agg(F.sum("_x.count").alias("c"))
        slack = both.select(*keys, "_slack")
        cut = self._cut(items.join(slack, list(keys)) if keys else items.crossJoin(F.broadcast(slack)), keys, F.col("_slack"))  # without keys slack is one row
        joined = both.join(cut, list(keys), "left") if keys else both.crossJoin(F.broadcast(cut))  # one row
        return joined.drop("_slack")

    def read(self, merged: DataFrame, keys: Sequence[str], ranks: Sequence[float] = (0.5,)) -> DataFrame:
        """``keys, n, total, n_distinct, quantiles, frequent``: the estimates that sketches give; quantiles at ``ranks``."""
        at = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(r))) for r in ranks])
        return merged.select(*keys, "n", "total", F.hll_sketch_estimate("distinct").alias("n_distinct"), at.alias("quantiles"), "frequent")
