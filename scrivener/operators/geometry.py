"""Page geometry on rows: grid cells, row propagation, template scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """Each row of ``df`` once for each cell (``row``, ``col``) of a grid."""
    return df.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long")))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))))


def propagate(first: Column, height: Column, spacing: Column, limit: Column, most: int) -> Column:
    """Starts of rows: first + k * (height + spacing) below ``limit``, ``most`` at most."""
    n = F.least(F.lit(most), 1 + F.floor(F.greatest(F.lit(0), limit - 1 - first) / (height + spacing)))
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda k: first + k * (height + spacing))


def weighted_score(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of part scores, kept between 0 and 1."""
    total = sum(c * w for c, w in parts) / sum(w for _, w in parts)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def fit_score(share: Column, scale: Column) -> Column:
    """Share of lines that fit, less for a stretched template, to three places."""
    return F.round(share * F.greatest(F.lit(0.0), 1 - 2 * F.abs(F.log(scale))), 3)
