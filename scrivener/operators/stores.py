"""Set-based forms of keyed stores: upserts, un-counts, replacement, status ladders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def counting_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], counts: Sequence[str], *, last: Sequence[str] = (), seq: str | None = None) -> DataFrame:
    """``old`` with ``new`` counted in: counts add up by key; ``last`` columns take the value with the greatest ``seq``."""
    cols = [*keys, *counts, *last, *([seq] if seq else [])]
    both = old.select(*cols).unionByName(new.select(*cols))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], *[F.max_by(c, seq).alias(c) for c in last], *([F.max(seq).alias(seq)] if seq else []))


def uncount(old: DataFrame, gone: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """``old`` with the counts of ``gone`` taken off, never below 0."""
    less = gone.groupBy(*keys).agg(F.sum(count).alias("_less"))
    return old.join(less, list(keys), "left").withColumn(count, F.greatest(F.col(count) - F.coalesce("_less", F.lit(0)), F.lit(0))).drop("_less")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` with keys that it lacks."""
    return old.unionByName(new.select(*old.columns).join(old.select(*keys), list(keys), "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def overlay(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], *, blank_keeps: bool = True) -> DataFrame:
    """Columns of ``old`` replaced by those of ``new`` where it has a value (a blank one counts as none)."""
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    value = lambda c: F.nullif(F.trim(F.col(f"_new_{c}")), F.lit("")) if blank_keeps else F.col(f"_new_{c}")
    return old.join(renamed, list(keys), "left").withColumns({c: F.coalesce(value(c), F.col(c)) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def changes(new: DataFrame, old: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Full outer comparison of two count tables: ``added`` and ``removed`` by key, where either is over 0."""
    a, b = new.select(*keys, F.col(count).alias("_n")), old.select(*keys, F.col(count).alias("_o"))
    d = F.coalesce("_n", F.lit(0)) - F.coalesce("_o", F.lit(0))
    return a.join(b, list(keys), "full").select(*keys, F.greatest(d, F.lit(0)).alias("added"), F.greatest(-d, F.lit(0)).alias("removed")).where("added > 0 or removed > 0")


def forward_only(ladder: Sequence[str], old: Column, new: Column) -> Column:
    """The later of two statuses on a ladder; one that is not on it never wins."""
    steps = F.array(*[F.lit(s) for s in ladder])
    step = F.greatest(F.coalesce(F.array_position(steps, old), F.lit(0)), F.coalesce(F.array_position(steps, new), F.lit(0)))
    return F.when(step > 0, F.get(steps, (step - 1).cast("int")))


def appended(old: DataFrame, new: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``old`` and ``new``, whose rows get the ids after ``old``'s greatest, in ``order``."""
    start = old.agg(F.coalesce(F.max(name), F.lit(0)).alias("_start"))
    placed = numbered(new, order, "_id").crossJoin(F.broadcast(start))  # one row
    return old.unionByName(placed.withColumn(name, (F.col("_id") + F.col("_start")).cast(old.schema[name].dataType)).select(*old.columns))


def checked_links(rows: DataFrame, key: str, wanted: DataFrame, roles: Sequence[str]) -> DataFrame:
    """``rows`` with the ``role`` and ``parent`` that ``wanted`` (key, role, parent) asks for, and ``error`` where that is not allowed.

    A role must be one of ``roles`` or null, a parent another row of the table. A change
    with an error is not made; rows that nobody asks to change stay as they are.
    """
    asked = wanted.select(F.col(key), F.col("role").alias("_role"), F.col("parent").alias("_parent"), F.lit(True).alias("_asked"))
    known = rows.select(F.col(key).alias("_parent"), F.lit(True).alias("_known"))
    # only changes that name a parent look for it: rows without one would all meet in one task
    named, bare = asked.where("_parent is not null"), asked.where("_parent is null").withColumn("_known", F.lit(None).cast("boolean"))
    found = rows.join(named.join(known, "_parent", "left").unionByName(bare), key, "left")
    error = F.when(F.col("_role").isNotNull() & ~F.col("_role").isin(*roles), "unknown role").when(F.col("_parent") == F.col(key), "own parent").when(F.col("_parent").isNotNull() & F.col("_known").isNull(), "no such parent")
    change = F.col("_asked").isNotNull() & F.col("_error").isNull()
    return found.withColumn("_error", error).select(*[c for c in rows.columns if c not in ("role", "parent")], F.when(change, F.col("_role")).otherwise(F.col("role")).alias("role"), F.when(change, F.col("_parent")).otherwise(F.col("parent")).alias("parent"), F.col("_error").alias("error"))


def checked_settings(settings: DataFrame, wanted: DataFrame, limits: Mapping[str, int], digits: Mapping[str, int]) -> DataFrame:
    """``setting, value, error``: ``settings`` with the values of ``wanted`` written over them where they are allowed.

    A setting must be one of ``limits`` and no longer than that; those of ``digits`` must
    have so many digits, and only these are kept. Null counts as ''.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    bare = F.regexp_replace(value, "[^0-9]", "")
    limit, count = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (limits, digits))
    want = F.try_element_at(count, F.col("setting"))
    error = F.when(~F.col("setting").isin(*limits), "unknown setting").when(F.length(value) > F.try_element_at(limit, F.col("setting")), "too long").when((value != "") & (F.length(bare) != want), "wrong number of digits")
    asked = wanted.select("setting", F.when(want.isNotNull(), bare).otherwise(value).alias("_new"), error.alias("error"))
    return settings.join(asked, "setting", "full").select("setting", F.when(F.col("_new").isNotNull() & F.col("error").isNull(), F.col("_new")).otherwise(F.col("value")).alias("value"), "error")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, child_key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) after the children in ``gone`` went and with them every parent left with none."""
    left = children.join(gone.select(child_key), child_key, "left_anti")
    touched = children.join(gone.select(child_key), child_key, "left_semi").select(parent_key).distinct()
    orphans = touched.join(left.select(parent_key), parent_key, "left_anti")
    return parents.join(orphans, parent_key, "left_anti"), left


def prepend_unique(items: Column, item: Column, n: int) -> Column:
    """``item`` put first, once, with at most ``n`` kept."""
    return F.slice(F.array_distinct(F.array_prepend(items, item)), 1, n)


def checksum(df: DataFrame) -> DataFrame:
    """Order-insensitive checksum: rows are hashed one by one, columns in order of name, and the hashes added, so no task gathers the table."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    row = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(row).alias("checksum"))
