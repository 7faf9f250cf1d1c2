"""Projections driven by metadata, typed values, header rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flat(df: DataFrame, catalog: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns that a catalog (form key to column) names, under their form keys."""
    return df.select(*keep, *[F.col(column).alias(key) for key, column in catalog.items()])


def first_with_origin(sources: Mapping[str, Column]) -> Column:
    """Struct (value, origin) of the first source that is not empty."""
    value = F.coalesce(*[F.nullif(c, F.lit("")) for c in sources.values()])
    origin = F.coalesce(*[F.when(F.nullif(c, F.lit("")).isNotNull(), F.lit(name)) for name, c in sources.items()])
    return F.struct(value.alias("value"), origin.alias("origin"))


def typed(c: Column, kind: str, *, values: Sequence[str] = (), longest: int | None = None) -> Column:
    """Text as a column value: ``date``, ``time``, ``enum`` (case-insensitive) or ``text``; null where it does not fit."""
    if kind == "date":
        return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    if kind == "time":
        return F.when(c.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d$"), c)
    if kind == "enum":
        out = F.when(F.lit(False), F.lit(""))
        for v in values:
            out = out.when(F.upper(c) == v.upper(), v)
        return out
    return F.when(F.length(c) <= longest, c) if longest is not None else c


def drop_header_rows(df: DataFrame, group: Sequence[str], row: str, text: str, header: str, *, words: int = 2, filled: int = 2, first: int = 3) -> DataFrame:
    """Rows of a group without those of too few filled cells and, among its first ones, those with ``words`` header cells."""
    rows = df.groupBy(*group, row).agg(F.count_if(F.col(text) != "").alias("_filled"), F.count_if(F.col(text).rlike(header)).alias("_heads"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(row)))
    return placed.where((F.col("_filled") >= filled) & ~((F.col("_place") <= first) & (F.col("_heads") >= words)))
