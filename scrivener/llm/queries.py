"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, mixing, periods, quality, rules, secrets, simhash, spelling, substrings, toxicity, warc
from .common import WORD, held_out, id_hash, staged, table


def op1_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = staged(docs.select("doc_id", "source", rules.text_counts(F.col("text")).alias("c")).select("doc_id", "source", "c.*"), "counts")
    judged = rules.judge(counted, host="source")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("_hits").alias("hit")).select(
        "doc_id", F.col("hit.item").alias("item_id"), "hit.similarity", F.col("hit.start").alias("start_word"), F.col("hit.words").alias("window_words"), "hit.distance"
    )


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "finding", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "path", "probability", "confirmed")


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = warc.write_archives(warc.record_chunks(pages), warc.archive_folder(spark))
    records = warc.record_digests(warc.read_chunks(manifest, with_data=False))
    ids = [F.col(c).try_cast("long").alias(a) for c, a in (("record_id", "page_id"), ("refers_to", "refers_to"))]
    return records.select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1])


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), mixing.by_turns(1, 2, 3))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), docs.where(~held_out("doc_id")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_lid.lang").alias("lang_pred"), F.col("_lid.score").alias("score"), F.col("_lid.margin").alias("margin"))


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    celled = staged(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), quality.cell(F.col("text")).alias("cell")), "cells")
    model = quality.learn(celled.where("not held_out"), labels.where(~held_out("doc_id", 4, 2)))
    scored = celled.select("doc_id", "held_out", quality.score(F.col("cell"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def repeating(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``, a tenth of the texts with their tail turned into a period: where h, the crc32 of the id, ends with 0.

    Word i from a = g % n on becomes word a + (i - a) % p, with g = h // 10 and p = 1 + (n - a) // (3 + g % 8).
    """
    h, g = id_hash("doc_id"), F.floor(id_hash("doc_id") / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1)))
    counted = docs.select("doc_id", "text", words.alias("w"), g.alias("g")).withColumn("n", F.size("w"))
    placed = counted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.col("n") - F.col("a")
    turned = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(tail / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(turned, F.lit(1), tail)), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeating(table(spark, sf_dir, "documents")).select("doc_id", periods.periodic_runs(F.col("text")).alias("r"))
    digests = F.sha2(periods.runs_text(F.col("r.runs")), 256).alias("runs_sha256"), F.sha2("r.collapsed", 256).alias("collapsed_sha256")
    return found.select("doc_id", F.size("r.runs").cast("long").alias("n_runs"), *(F.col(f"r.top.{c}").alias(c) for c in ("start", "length", "period", "exponent_milli")), *digests)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), misspell=199))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_toxicity": op1_pu_toxicity,
    "op2_host_rules": op2_host_rules,
    "op3_secret_forest": op3_secret_forest,
    "op4_warc_chunks": op4_warc_chunks,
    "op5_source_mix": op5_source_mix,
    "op6_license_dice": op6_license_dice,
    "op7_repeated_substrings": op7_repeated_substrings,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_pu_quality": op11_pu_quality,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op2_host_rules": rules.oracle(),
    "op6_license_dice": licenses.oracle(),
    "op13_spelling_variants": spelling.oracle(),
}
