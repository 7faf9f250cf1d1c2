"""A corpus pipeline over ``documents``: five stages, each calling one operator of the library.

Language ID drops texts that no language claims, one document of each group of near
duplicates stays (linked by 4/5 of their five-word shingles), decontamination drops
documents with benchmark passages, the secret scan masks confirmed secrets, and the mix
repeats or leaves out documents so that every source meets its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import decontaminate, language, mixing, secrets, similar, simhash
from scrivener.llm.common import held_out, staged, table, unused

#: A text is rejected if the runner-up language needs less than this share more bytes.
LANGUAGE_MARGIN = 0.003
#: Columns of ``documents``.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose two best languages are as good as tied."""
    (name,) = unused(docs, "_lid")
    found = language.identify(docs, docs.where(~held_out("doc_id")), out=name)
    sure = (F.col(name)["lang"] != language.UNKNOWN) & (F.col(name)["margin"] >= LANGUAGE_MARGIN)
    return found.where(sure).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return simhash.keep_one(docs, find=similar.near_duplicates)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a passage of ``benchmark`` is found."""
    (name,) = unused(docs, "_hits")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), out=name)
    return found.where(F.size(name) == 0).select(*docs.columns)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks confirmed secrets in the texts; all rows stay."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes at least once, with how often, by size and source."""
    mixed = mixing.mix(docs, mixing.by_turns(1, 2, 3))
    return mixed.where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_masking),
    ("source_mix", source_mix),
]

#: Compression sizes and random forests are beyond SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
