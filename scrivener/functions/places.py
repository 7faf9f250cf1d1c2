"""Addresses and place names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse


def canonical(c: Column) -> Column:
    """Capitals, without ``CITY OF`` in front and remarks in brackets at the end."""
    return collapse(F.regexp_replace(F.upper(c), r"^CITY OF |\s*\(.*\)$", ""))


def split_address(c: Column, *, cities: Sequence[str], barangays: Sequence[str]) -> Column:
    """Struct (lot, phase, subdivision, street, sitio, barangay, city) of an address with comma-separated parts.

    Parts are told by their words (block or lot, phase, subdivision or village, street or
    road, purok or sitio) or by the given names; the last part that fits a kind wins.
    Parts in capitals, null where there is none.
    """
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.upper(collapse(p))), lambda p: p != "")
    last = lambda cond: F.get(F.reverse(F.filter(parts, cond)), F.lit(0))
    told = lambda words: last(lambda p: p.rlike(rf"\b(?:{words})\b"))
    city = last(lambda p: p.isin(*cities) | p.isin(*[x.removesuffix(" CITY") for x in cities]))
    return F.struct(
        told("BLK|BLOCK|LOT").alias("lot"), told("PHASE|PH").alias("phase"), told("SUBD|SUBDIVISION|VILLAGE|HOMES").alias("subdivision"), told("ST|STREET|ROAD|RD|AVE|AVENUE").alias("street"),
        told("PUROK|PRK|SITIO").alias("sitio"), last(lambda p: F.regexp_replace(p, r"^(?:BRGY\.?|BARANGAY)\s+", "").isin(*barangays)).alias("barangay"),
        F.when(city.isNotNull() & ~F.endswith(city, F.lit(" CITY")) & F.concat(city, F.lit(" CITY")).isin(*cities), F.concat(city, F.lit(" CITY"))).otherwise(city).alias("city"),
    )
