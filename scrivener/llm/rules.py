"""Quality rules by document, and verdicts on whole hosts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
#: A host is rejected if its shrunken share of failing documents is over this.
MAX_HOST_RATE = 0.5
#: The prior weighs as much as this many documents at least, so that a document or two never condemn a host.
MIN_STRENGTH = 4.0
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the list.

    Exact: windows get ids by doubling (ids of pairs of ids), never by hashing.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    have = 1
    while have < window:
        step = min(have, window - have)
        left, right = ids[: len(ids) - step], ids[step:]
        _, ids = np.unique(left * (int(ids.max()) + 1) + right, return_inverse=True)
        have += step
        if ids.max() + 1 == len(ids):
            return 0
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text; zeros for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                raw = t.encode("utf-8", "replace") if t else b""
                words = raw.split()
                flat = b"".join(words)
                chars = len(flat) if flat.isascii() else len(flat.decode())
                symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
                lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
                out.append((len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)))
            yield pd.DataFrame(out, columns=list(_COUNTS), dtype="int64")

    return F.pandas_udf(run, ", ".join(f"{c} long" for c in _COUNTS))(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_rates(flags: DataFrame, *, host: str, failed: str = "base_failed") -> DataFrame:
    """One row a host (null is a host): ``n_docs``, ``n_failed``, ``prior_a``, ``prior_b`` and ``rate``.

    ``rate`` is (n_failed + a) / (n_docs + a + b) with a beta prior fitted to the hosts'
    raw rates by moments, so small hosts lean on the others; a spread so wide that the
    prior would weigh less than ``MIN_STRENGTH`` documents gives one of that weight. Fewer
    than two hosts, or rates that are all 0 or all 1, give the prior 1, 1. Counts are
    combined before the shuffle, so a host with a third of the rows costs no more than
    another.
    """
    by_host = flags.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    moments = by_host.agg(F.avg(raw).alias("_m"), F.var_samp(raw).alias("_v"))
    strength = F.col("_m") * (1 - F.col("_m")) / F.nullif(F.col("_v"), F.lit(0.0)) - 1
    prior = moments.select("_m", F.when(F.col("_v").isNotNull() & (F.col("_m") > 0) & (F.col("_m") < 1), F.greatest(F.coalesce(strength, F.lit(MIN_STRENGTH)), F.lit(MIN_STRENGTH))).alias("_s")).select(
        F.coalesce(F.col("_m") * F.col("_s"), F.lit(1.0)).alias("prior_a"), F.coalesce((1 - F.col("_m")) * F.col("_s"), F.lit(1.0)).alias("prior_b")
    )
    # one row: the prior
    return by_host.crossJoin(F.broadcast(prior)).withColumn("rate", (F.col("n_failed") + F.col("prior_a")) / (F.col("n_docs") + F.col("prior_a") + F.col("prior_b")))


def judge(counted: DataFrame, *, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``counted`` (rows with the counts and ``host``) with base_failed, host_rate, host_failed and kept (in place of columns so named).

    A document is kept if it passes the base rules and its host's shrunken failure rate is
    at most ``max_rate``. The host verdicts join back on a null-safe key; the verdicts of
    a hot host are one row, and skewed partitions of documents are split by Spark.
    """
    flagged = counted.drop("host_rate", "host_failed", "kept").withColumn("base_failed", base_failed())
    (name,) = unused(flagged, "_host")
    rates = host_rates(flagged.select(host, "base_failed"), host=host).select(F.col(host).alias(name), F.col("rate").alias("host_rate"))
    joined = flagged.join(rates, F.col(host).eqNullSafe(F.col(name)), "left").drop(name)
    return joined.withColumn("host_failed", F.col("host_rate") > max_rate).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def oracle(max_rate: float = MAX_HOST_RATE) -> str:
    """Counts and verdicts over ``documents``, with ``source`` as host, in DuckDB SQL. Words and lines are those of ASCII white space."""
    return f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
 rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
 cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, {WINDOW}) r(k) GROUP BY 1),
 lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
 c AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
 f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM c),
 h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY 1),
 m AS (SELECT avg(k::DOUBLE / n) AS m, var_samp(k::DOUBLE / n) AS v FROM h),
 s AS (SELECT m, CASE WHEN v IS NOT NULL AND m > 0 AND m < 1 THEN greatest(coalesce(m * (1 - m) / nullif(v, 0) - 1, {MIN_STRENGTH}), {MIN_STRENGTH}) END AS s FROM m),
 r AS (SELECT source, (k + coalesce(m * s, 1)) / (n + coalesce(m * s, 1) + coalesce((1 - m) * s, 1)) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {max_rate} AS kept FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source"""
