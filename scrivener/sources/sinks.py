"""File sinks and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which all executors share; where that is unset and Spark is one local process (tests), a folder of our own.

    On a cluster a shared folder must be named; without one this fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="scrivener-"))
        base = _own[0]
    return f"{base.rstrip('/')}/scrivener/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again, so that plans that use it several times do not grow with what made it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text for flat files: lists joined by ``; ``, and text that a spreadsheet would take for a formula quoted."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        kind = f.dataType.simpleString()
        c = F.array_join(c.cast("array<string>"), "; ") if kind.startswith("array") else F.to_json(c) if kind.startswith(("struct", "map")) else c.cast("string")
        out.append(F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c).alias(f.name) if kind == "string" else c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> str:
    as_text(df).write.csv(path, header=True)
    return path


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> str:
    """JSON lines, in folders by the columns of ``by``; Spark's commit makes the result appear whole or not at all."""
    df.write.partitionBy(*by).json(path) if by else df.write.json(path)
    return path


def sheet_names(names: Sequence[str]) -> list[str]:
    """Names of at most 31 characters without marks that workbooks reject, made distinct by a number."""
    taken: list[str] = []
    for n in names:
        plain = "".join("_" if c in "[]:*?/\\" else c for c in n)[:31] or "Sheet"
        found, i = plain, 2
        while found.lower() in (x.lower() for x in taken):
            found = f"{plain[: 31 - len(str(i)) - 1]}_{i}"
            i += 1
        taken.append(found)
    return taken


def write_sheets(sheets: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """One CSV folder a sheet; the paths by sheet name."""
    return {key: write_csv(df, f"{path}/{name}") for (key, df), name in zip(sheets.items(), sheet_names(list(sheets)))}


def collect_summaries(summaries: Mapping[str, DataFrame]) -> DataFrame:
    """Summaries of several tests as one table with the test's name; missing columns are null."""
    out = None
    for name, df in summaries.items():
        one = df.withColumn("test", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def truncate(df: DataFrame) -> DataFrame:
    """The table without rows."""
    return df.where(F.lit(False))
