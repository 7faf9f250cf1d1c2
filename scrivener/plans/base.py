"""Registration of queries with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as attributes: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of :class:`Tables` under ``name``, with its SQL where SQL can say it."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out over all shuffle partitions, for much work a row: a table of short rows is one row group or two, which as many tasks read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Readings of part names, as two engines might have read them from a page, in DuckDB SQL and below in Spark.
CELLS = """c0 AS (SELECT p_partkey AS cell, p_brand AS writer, CASE WHEN p_partkey % 2 = 0 THEN 'caps' ELSE 'lower' END AS style,
  p_partkey // 8 AS page, p_partkey % 8 AS row, p_type AS field, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE upper(p_name) END AS truth,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'X' END WHEN p_partkey % 5 = 0 THEN replace(upper(p_name), 'E', '3')
   WHEN p_partkey % 7 = 0 THEN substr(upper(p_name), 1, length(p_name) - 1) ELSE upper(p_name) END AS raw, p_size, p_partkey % 9 <> 0 AS detected FROM part),
cells AS (SELECT cell, writer, style, page, row, field, truth, raw, CASE WHEN raw IS NULL THEN NULL WHEN cell % 10 = 0 THEN truth WHEN cell % 11 = 0 THEN raw || 'Z' ELSE raw END AS corrected,
  CASE WHEN raw IS NULL THEN NULL ELSE (p_size * 7 % 50)::DOUBLE / 100 + 0.5 END AS confidence, detected FROM c0)"""


def cells(t: Tables) -> DataFrame:
    """Evaluation cells derived from ``part``: truth, raw and corrected reading (null: not read), confidence."""
    k, name = F.col("p_partkey"), F.upper("p_name")
    raw = (
        F.when(k % 13 == 0, None)
        .when(k % 17 == 0, F.when(k % 2 == 0, "").otherwise("X"))
        .when(k % 5 == 0, F.replace(name, F.lit("E"), F.lit("3")))
        .when(k % 7 == 0, F.substring(name, F.lit(1), F.length("p_name") - 1))
        .otherwise(name)
    )
    base = t.part.select(
        k.alias("cell"), F.col("p_brand").alias("writer"), F.when(k % 2 == 0, "caps").otherwise("lower").alias("style"), F.floor(k / 8).alias("page"), (k % 8).alias("row"),
        F.col("p_type").alias("field"), F.when(k % 17 == 0, "").otherwise(name).alias("truth"), raw.alias("raw"), "p_size", (k % 9 != 0).alias("detected"),
    )
    corrected = F.when(F.col("raw").isNull(), None).when(F.col("cell") % 10 == 0, F.col("truth")).when(F.col("cell") % 11 == 0, F.concat("raw", F.lit("Z"))).otherwise(F.col("raw"))
    confidence = F.when(F.col("raw").isNotNull(), (F.col("p_size") * 7 % 50).cast("double") / 100 + 0.5)
    return base.select("cell", "writer", "style", "page", "row", "field", "truth", "raw", corrected.alias("corrected"), confidence.alias("confidence"), "detected")
