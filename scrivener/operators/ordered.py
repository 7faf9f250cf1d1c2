"""Operators on ordered rows: latest, ranks, fill-down, neighbours, islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by ``order`` (which must not tie): one aggregate with map-side combine, no sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``name``: the row's place (from 1) in the order of the whole table, found without gathering it in one task.

    Rows are dealt out by ranges of the order and written once, so that ranges and counts
    belong together; a row's place is that in its range and the count of the ranges before.
    """
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    # one row a range: partitions, not data
    ahead = held.groupBy("_range").count().withColumn("_ahead", F.sum("count").over(Window.orderBy("_range")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return held.withColumn("_in_range", place).join(F.broadcast(ahead), "_range").withColumn(name, F.col("_in_range") + F.col("_ahead")).drop("_range", "_in_range", "_ahead")


def _ahead(held: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """``_in, _k0.., _ahead, _all``: by range and key the amount of the key in the ranges before, and in all. One row a range and key, at most the ranges and keys together."""
    by, w = held.groupBy("_range", *keys).agg(amount.alias("_here")), Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_here").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by.select(F.col("_range").alias("_in"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], before.alias("_ahead"), F.sum("_here").over(w).alias("_all"))


def _with_ahead(df: DataFrame, keys: Sequence[str], ahead: DataFrame) -> DataFrame:
    on = [F.col("_range") == F.col("_in"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    return df.join(ahead, on).drop("_in", *[f"_k{i}" for i in range(len(keys))])


def ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], tiles: int) -> DataFrame:
    """``df`` with ``tile`` (of ``tiles``), ``below`` (cumulative share) and ``share`` (percent rank) of each row of its key, where few keys hold all rows.

    Rows are dealt out by ranges of (``keys``, ``order``) and written once; places are those
    in the range and the rows of the key in the ranges before. Rows equal in ``order`` are in one range.
    """
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    w = Window.partitionBy("_range", *keys).orderBy(*order)
    local = held.withColumns({"_row": F.row_number().over(w), "_rank": F.rank().over(w), "_upto": F.count("*").over(w)})
    found = _with_ahead(local, keys, _ahead(held, keys, F.count("*")))
    n, row, size = F.col("_all"), F.col("_row") + F.col("_ahead") - 1, F.floor(F.col("_all") / tiles)
    # the first n % tiles tiles have one row more
    long_ = n % tiles
    tile = F.when(row < long_ * (size + 1), F.floor(row / (size + 1))).otherwise(long_ + F.floor((row - long_ * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    share = F.when(n > 1, (F.col("_rank") + F.col("_ahead") - 1) / (n - 1)).otherwise(0.0)
    return found.select(*df.columns, tile.cast("long").alias("tile"), ((F.col("_upto") + F.col("_ahead")) / n).alias("below"), share.alias("share"))


def count_within(df: DataFrame, keys: Sequence[str], value: str, reach: float, name: str) -> DataFrame:
    """``keys, value, name``: how many rows of the key lie within ``reach`` of each distinct value, without visiting them value by value.

    Values and both ends of each one's frame are put in one order. A running total over ranges
    of it is the rows up to any place, so a count is the difference of two, in time linear in the rows. Null values count as near to each other only.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    point = lambda at, kind, n: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), n.alias("_w"))
    v, none = F.col("_v"), F.lit(0).cast("long")
    path = scratch(df.sparkSession, "points")
    points = counts.select(*keys, "_v", F.inline(F.array(point(v - reach, -1, none), point(v, 0, F.col("_n")), point(v + reach, 1, none))))
    points.repartitionByRange(*keys, "_at", "_kind").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    w = Window.partitionBy("_range", *keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = held.withColumn("_sum", F.sum("_w").over(w)).where("_kind <> 0")
    found = _with_ahead(ends, keys, _ahead(held, keys, F.sum("_w")))
    total = F.sum(F.col("_kind") * (F.col("_sum") + F.col("_ahead")))
    return found.groupBy(*keys, "_v").agg(total.alias(name)).withColumnRenamed("_v", value)


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def fill_down(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, missing: Column, name: str, *, own: bool = True, default: Column | None = None) -> DataFrame:
    """``name``: the row's value, or where ``missing`` holds the nearest earlier value of its key.

    With ``own`` false the frame ends before the row, so the result is the earlier value for every row.
    """
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    found = F.last(F.when(~missing, value), ignorenulls=True).over(frame)
    return df.withColumn(name, F.coalesce(found, default) if default is not None else found)


def fill_down_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, missing: Column, name: str, *, own: bool = True, default: Column | None = None) -> DataFrame:
    """:func:`fill_down` where a key may hold any share of the rows, up to all: a scan in two passes over ranges of (``keys``, ``order``).

    Rows are dealt out by ranges and written once. Each range is filled by itself, side by
    side with the others of its key; the last value of each key in each range is a row of a
    small table, and the latest of the ranges before is carried into a range that its key
    enters. Only keys that lie in several ranges are in that table, so it has at most two rows a
    range and is sent to all tasks. Columns of ``order`` ascend, nulls first, and should not tie.
    """
    path = scratch(df.sparkSession, "ranges")
    value_, range_ = "_value", "_range"
    df.withColumn(value_, F.when(~missing, value)).repartitionByRange(*keys, *order).withColumn(range_, F.spark_partition_id()).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    frame = Window.partitionBy(range_, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    local = held.withColumn("_local", F.last(value_, ignorenulls=True).over(frame))
    known = F.when(F.col(value_).isNotNull(), F.struct(*order))
    ends = held.groupBy(range_, *keys).agg(F.max_by(value_, known).alias("_last"))
    # a key in several ranges lies at an end of each of them
    span = ends.groupBy(*keys).agg(F.min(range_).alias("_lo"), F.max(range_).alias("_hi")).where("_lo < _hi")
    same = [F.col(f"ends.{k}").eqNullSafe(F.col(f"span.{k}")) for k in keys]
    several = ends.alias("ends").join(F.broadcast(span.alias("span")), same, "left_semi") if keys else ends
    earlier = Window.partitionBy(*keys).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    carry = several.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).where("_carry is not null").select(F.col(range_).alias("_in"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_carry")
    on = [F.col(range_) == F.col("_in"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    filled = F.coalesce("_local", "_carry", *([default] if default is not None else []))
    return local.join(F.broadcast(carry), on, "left").select(*df.columns, filled.alias(name))


def islands(df: DataFrame, keys: Sequence[str], order: Column, gap: Column | float, name: str = "island") -> DataFrame:
    """Numbers the runs of rows whose successive ``order`` values are at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = order - F.lag(order).over(w)
    new = F.when(step.isNull() | (step > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def best_neighbour(df: DataFrame, keys: Sequence[str], order: Column, mine: Column, score, names: tuple[str, str, str] = ("own", "above", "below")) -> DataFrame:
    """Scores of a row's own value and of the next lower and higher rows' values, by ``score(value)``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(names[0], score(mine)).withColumn(names[1], score(F.lag(mine).over(w))).withColumn(names[2], score(F.lead(mine).over(w)))


def share_equally(df: DataFrame, keys: Sequence[str], total: Column, name: str) -> DataFrame:
    """A group's total dealt out equally to its rows."""
    return df.withColumn(name, total / F.count("*").over(Window.partitionBy(*keys)))
