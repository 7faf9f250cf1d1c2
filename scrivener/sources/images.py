"""Readings of images: tokens from any engine, words put together into lines, text laid out on forms."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = "path string, place int, text string, confidence double, box array<double>"


def tokens(files: DataFrame, engine: Callable[[bytes], Iterable[tuple[str, float, Sequence[float]]]]) -> DataFrame:
    """Rows ``path, place, text, confidence, box`` of what ``engine`` reads in each file's ``content``.

    Files stream through the engine one at a time; null and empty ones give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = [(path, i, text, float(c), [float(x) for x in box]) for i, (text, c, box) in enumerate(engine(bytes(content)))] if content else []
                yield pd.DataFrame(found, columns=["path", "place", "text", "confidence", "box"])

    return files.select("path", "content").mapInPandas(run, TOKENS)


def lines_of_words(words: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``keys, text, confidence, x0, y0, x1, y1``: the words of each line joined, blank ones and those without a confidence left out.

    ``words`` has ``text``, ``confidence`` (0 to 100, negative: none) and a box ``x0`` to
    ``y1``; the line's confidence is the mean of its words' as a share.
    """
    read = words.where((F.trim("text") != "") & (F.col("confidence") >= 0))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return read.groupBy(*keys).agg(joined.alias("text"), (F.avg("confidence") / 100).alias("confidence"), *box)


def wrapped(text: Column, width: Column) -> Column:
    """Lines of whole words with at most ``width`` characters; a longer word has a line of its own. None for blanks and ``N/A``."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    words = F.when((plain == "") | F.upper(plain).isin("N/A", "NA"), F.array().cast("array<string>")).otherwise(F.split(plain, " "))

    def put(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.length(last) + 1 + F.length(word) <= width)
        kept = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.when(fits, F.array_append(kept, F.concat_ws(" ", last, word))).otherwise(F.array_append(lines, word))

    return F.aggregate(words, F.array().cast("array<string>"), put)


def placed(fields: DataFrame, keys: Sequence[str], page_width: float, page_height: float, *, letter: float = 0.5) -> DataFrame:
    """``keys, line, text, x, y``: the values of a form's boxes as lines of text at positions in points.

    ``fields`` has ``value``, ``x`` and ``y`` (percent of the page from its upper left),
    ``width`` (percent) and ``size`` (of the type, in points); text too wide for its box
    goes on below. A letter is taken to be ``letter`` of its size wide.
    """
    most = F.greatest(F.lit(1), F.floor(F.col("width") / 100 * page_width / (F.col("size") * letter)).cast("int"))
    lines = fields.select(*keys, "x", "y", "size", F.posexplode(wrapped(F.col("value"), most)).alias("line", "text"))
    return lines.select(*keys, "line", "text", (F.col("x") / 100 * page_width).alias("x"), (page_height - F.col("y") / 100 * page_height - F.col("line") * F.col("size") * 1.2).alias("y"))
