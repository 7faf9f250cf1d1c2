"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark is one local process (tests), one of our own.

    On a cluster a folder that all machines share must be named; without one this fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="scrivener-"))
    return _own_dir[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation. The tables
    stay until the folder is cleared, as checkpoints do, since results read them lazily.
    """
    path = f"{shared_dir(df.sparkSession)}/scrivener/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of phases whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(doc_id: Column | str) -> Column:
    """crc32 of the id as text; null for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary"))


def held_out(doc_id: Column | str, modulus: int = 5, rest: int = 0) -> Column:
    """True where crc32 of the id as text leaves ``rest`` on division by ``modulus``; false for a null id."""
    return F.coalesce(id_hash(doc_id) % modulus == rest, F.lit(False))
