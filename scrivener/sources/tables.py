"""Table sources and their checks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has_columns(df: DataFrame, *names: str) -> bool:
    """Whether a table has been brought to a version with these columns."""
    return set(names) <= set(df.columns)


def whitelist(df: DataFrame, allowed: Sequence[str], label: str = "table") -> DataFrame:
    """``df`` if it has allowed columns only; else an error that names the others."""
    unknown = [c for c in df.columns if c not in allowed]
    if unknown:
        raise ValueError(f"unknown columns for {label}: {', '.join(unknown)}")
    return df


def describe(df: DataFrame) -> DataFrame:
    """``column_name, longest, n_null`` of each text column, in one pass."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    one = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.max(F.length(c)).cast("long").alias("longest"), F.count_if(F.col(c).isNull()).alias("n_null")).alias(f"_{i}") for i, c in enumerate(texts)])
    return one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(texts))])))


def csv_table(spark: SparkSession, path: str, schema: str, *, key: str, allowed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A CSV file with a header; rows with a blank key are dropped, a leading byte-order mark too.

    ``allowed`` gives closed sets of values; another value fails the read when it is met.
    """
    df = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    df = df.withColumn(key, F.regexp_replace(key, "^﻿", "")).where(F.coalesce(F.trim(key), F.lit("")) != "")
    for column, values in (allowed or {}).items():
        bad = F.concat(F.lit(f"{column}: unknown value "), F.coalesce(F.col(column), F.lit("null")))
        df = df.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)).otherwise(F.raise_error(bad).cast("string")))
    return df


def json_folder(spark: SparkSession, path: str, schema: str, *, pattern: str = "*.json") -> DataFrame:
    """One document a file, with its ``file_name``; files that hold no such document are left out."""
    df = spark.read.option("pathGlobFilter", pattern).json(path, schema=schema, multiLine=True, mode="DROPMALFORMED")
    return df.select("*", F.col("_metadata.file_name").alias("file_name"))


def json_document(spark: SparkSession, folder: str, doc_id: str, schema: str) -> DataFrame:
    """One JSON document by its id, which may hold letters, digits, ``_``, ``-`` and ``=`` only, so that it never leads out of the folder."""
    if not re.fullmatch(r"[\w=-]+", doc_id, re.ASCII):
        raise ValueError(f"not a document id: {doc_id!r}")
    return spark.read.json(f"{folder.rstrip('/')}/{doc_id}", schema=schema)


def check_codes(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """``df`` if every ``column`` matches ``pattern`` as a whole; else an error that says how many values do not, and none of them."""
    bad = df.where(~F.coalesce(F.trim(column).rlike(f"^(?:{pattern})$"), F.lit(False))).select(column).distinct().count()
    if bad:
        raise ValueError(f"{column}: {bad} value(s) are no codes of the form {pattern}")
    return df


def sheet_rows(sheet: DataFrame, key: Sequence[str], number: str, cells: str) -> DataFrame:
    """Rows of sheets (``number``, ``cells``: an array of texts) as maps by heading.

    The heading is a sheet's first row with two or more texts that are no numbers; rows
    before it and rows without any filled cell are dropped, and so are cells below no heading.
    """
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    words = F.size(F.filter(cells, lambda c: filled(c) & c.try_cast("double").isNull()))
    heads = sheet.where(words >= 2).groupBy(*key).agg(F.min(number).alias("_head"), F.min_by(cells, number).alias("_names"))
    below = sheet.join(heads, list(key)).where((F.col(number) > F.col("_head")) & F.exists(cells, filled))
    named = F.filter(F.arrays_zip(F.col("_names").alias("k"), F.col(cells).alias("v")), lambda x: filled(x["k"]))
    return below.select(*key, number, F.map_from_entries(named).alias("row"))


def statements(text):
    """The statements of an SQL script: ``--`` comments dropped, parted at ``;``, blank ones left out."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "--[^\n]*", ""), ";"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def has_extension(name, allowed: Sequence[str]):
    """Whether a file's name ends in one of the extensions, in any case; false without one."""
    return F.coalesce(F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1)).isin(*allowed), F.lit(False))


def row_ranges(c):
    """Array of the row numbers in a text such as ``1-3,7``; null for ``all``."""
    parts = F.split(F.regexp_replace(c, r"\s", ""), ",")
    ends = lambda p: F.split(p, "-")
    spread = F.flatten(F.transform(parts, lambda p: F.sequence(ends(p)[0].cast("int"), F.element_at(ends(p), -1).cast("int"))))
    return F.when(F.lower(F.trim(c)) != "all", F.array_sort(F.array_distinct(spread)))


def image_tree(spark: SparkSession, path: str) -> DataFrame:
    """Files of an image tree: ``category`` (top folder), ``name``, ``length``, ``content``; reading the pixels is left to a function of ``content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("category"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def or_default(df: DataFrame | None, default: DataFrame) -> DataFrame:
    """``df`` if it is there and has rows, else ``default``."""
    return default if df is None or df.isEmpty() else df
