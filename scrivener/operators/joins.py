"""Joins that need care at scale: bands, day ranges, rules with wildcards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, width: int) -> DataFrame:
    """Pairs of one key with whole numbers ``a`` and ``b`` at most ``width`` apart.

    The right side is copied to the 2 * width + 1 positions that it can meet, which makes
    the band an equality: no pair is formed that the band does not hold.
    """
    spread = right.withColumn("_at", F.explode(F.sequence(F.col(b) - width, F.col(b) + width)))
    return left.withColumn("_at", F.col(a)).join(spread, [*keys, "_at"]).drop("_at")


def day_range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, least: int, most: int) -> DataFrame:
    """Pairs of one key in which date ``b`` lies ``least`` to ``most`` days after date ``a``, as an equality on days."""
    spread = left.withColumn("_day", F.explode(F.sequence(F.date_add(F.col(a), least), F.date_add(F.col(a), most))))
    return spread.join(right.withColumn("_day", F.col(b)), [*keys, "_day"]).drop("_day")


def wildcard_rules(columns: Sequence[Column], rules: Sequence[tuple], any_value: str = "*") -> Column:
    """The verdict of the most specific rule that fits: rules are (value or ``*`` for each column, verdict).

    Rules with fewer wildcards come first; of equals the first given. A short rule list
    belongs in the expression, so rows are neither joined nor shuffled.
    """
    out = None
    for *values, verdict in sorted(rules, key=lambda r: sum(v == any_value for v in r[:-1])):
        fits = F.lit(True)
        for c, v in zip(columns, values):
            if v != any_value:
                fits = fits & (c == v)
        out = F.when(fits, verdict) if out is None else out.when(fits, verdict)
    return out if out is not None else F.lit(None)
