"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bounded training sample: this many texts a language, a stretch of this many characters from anywhere in each.
SAMPLE_TEXTS, SAMPLE_CHARS = 64, 500
#: Texts are compressed in pieces of this size, so that the dictionary weighs as much in long texts as in short ones.
PIECE_BYTES = 1024
#: Appended to each piece: zstandard stores very short input as it is, which would tell languages apart by nothing.
PAD = b" " * 64
#: Bytes of a frame that say nothing of its content.
FRAME_BYTES = 8
#: What is compressed: ASCII letters in lower case and all bytes beyond ASCII; the rest counts as white space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """The letters of a text in UTF-8, runs of anything else as one space."""
    return b" ".join(text.encode("utf-8", "replace").translate(LETTERS).split())


def sample_dictionaries(training: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null language of ``training``.

    The sample is fixed by a hash of ``key``: of each of ``texts`` hash buckets of a
    language, the row with the least hash. The search is one map-side combined
    aggregate over keys only; the driver gets ``texts * chars`` characters a language, each
    stretch from a place that the hash picks in the whole text. Of rows that share language
    and key the smallest stretch is taken.
    Rows with a null key, text or language teach nothing.
    """
    own = training.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    usable = own.where("_key is not null and _lang is not null and _text is not null")
    h = F.xxhash64(F.lit(17), "_key")
    picked = usable.select("_lang", "_key", h.alias("_h")).groupBy("_lang", F.pmod("_h", F.lit(texts)).alias("_bucket")).agg(F.min_by("_key", "_h").alias("_key"))
    # texts * (number of languages) keys: bounded by parameter, so safe to broadcast
    chosen = usable.join(F.broadcast(picked.select("_lang", "_key")), ["_lang", "_key"])
    start = F.pmod(F.xxhash64(F.lit(23), "_key"), F.greatest(F.length("_text") - chars + 1, F.lit(1)).cast("long")) + 1
    rows = chosen.groupBy("_lang", "_key").agg(F.min(F.substring("_text", start.cast("int"), F.lit(chars))).alias("part")).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["_lang"], str(r["_key"]))):
        found.setdefault(r["_lang"], []).append(r["part"])
    return {k: b" ".join(map(letters, v)) for k, v in found.items()}


def classify(text: Column, dictionaries: dict[str, bytes], *, level: int = 5) -> Column:
    """Struct ``(lang, score, margin)`` of a whole text.

    ``lang`` is the language whose dictionary compresses the text to the fewest bytes
    (ties: the first in code-point order), or ``und`` if the text is null or has no
    letter or nothing was learned. ``margin`` is the runner-up's surplus as a share of
    the best size (1.0 where only one language is known); reject where it is narrow.
    ``score`` is the best language's share of 2 to the power of minus the sizes in bytes,
    0.0 for ``und``.
    """
    names = sorted(dictionaries)
    blobs = [dictionaries[n] for n in names]

    def sizes(packers: list, raw: bytes) -> np.ndarray:
        out = np.ones(len(packers))
        for at in range(0, len(raw), PIECE_BYTES):
            piece = raw[at : at + PIECE_BYTES] + PAD
            out += [len(p.compress(piece)) - FRAME_BYTES for p in packers]
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packers = []
        for blob in blobs:
            d = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        for batch in batches:
            out = []
            for t in batch:
                if t is None or not packers or not any(map(str.isalpha, t)):
                    out.append((UNKNOWN, 0.0, 0.0))
                    continue
                s = sizes(packers, letters(t))
                best = int(s.argmin())
                rest = np.delete(s, best)
                share = float(1 / np.exp2(np.minimum(0, s[best] - s)).sum())
                out.append((names[best], share, float(rest.min() / s[best] - 1) if len(rest) else 1.0))
            yield pd.DataFrame(out, columns=["lang", "score", "margin"])

    return F.pandas_udf(run, "lang string, score double, margin double")(text)


def identify(docs: DataFrame, training: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", out: str = "_lid", **sample) -> DataFrame:
    """``docs`` with a column ``out`` as :func:`classify` gives it, learned from ``training``.

    A narrow map over the documents: no shuffle of texts. Other columns stay as they are;
    ``out`` must be none of them. An empty table gives an empty table.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"documents have a column {out}")
    learned = sample_dictionaries(training, text=text, lang=lang, key=key, **sample)
    return docs.withColumn(out, classify(F.col(text), learned))
