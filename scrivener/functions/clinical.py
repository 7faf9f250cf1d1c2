"""Features that a diagnosis text states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def features(c: Column) -> Column:
    """Struct (gravida, para, weeks, sex, weight in kg) of what a text says; null where it does not."""
    number = lambda p, kind="int": F.regexp_extract(c, p, 1).try_cast(kind)
    return F.struct(
        number(r"(?i)\bG\s*(\d+)").alias("gravida"),
        number(r"(?i)\bG\s*\d+\s*P\s*(\d+)").alias("para"),
        number(r"(?i)(\d+)\s*(?:WKS?|WEEKS?)\b").alias("weeks"),
        F.nullif(F.lower(F.regexp_extract(c, r"(?i)BABY\s+(BOY|GIRL)", 1)), F.lit("")).alias("sex"),
        number(r"(?i)(\d+(?:\.\d+)?)\s*KGS?\b", "double").alias("weight"),
    )


def gravida_para(c: Column) -> Column:
    """Struct of the two numbers of ``G2P1`` in a text, as written; null where it has none."""
    part = lambda i: F.nullif(F.regexp_extract(F.upper(c), r"\bG(?:RAVIDA)?\s*(\d+)[\s,]*P(?:ARA)?\s*(\d+)", i), F.lit(""))
    return F.struct(part(1).alias("gravida"), part(2).alias("para"))


def delivery_mode(c: Column) -> Column:
    """CESAREAN or VAGINAL by the words of a text, operations first; null for neither."""
    t = F.upper(c)
    return F.when(t.rlike(r"CA?ESAREAN|\b(?:LT)?CS\b"), "CESAREAN").when(t.rlike(r"NSV?D\b|SPONTANEOUS VERTEX|NORMAL SPONTANEOUS|VAGINAL"), "VAGINAL")


def weeks_of_gestation(c: Column) -> Column:
    """The two-digit weeks before ``WKS AOG`` or ``WEEKS AOG``, days in sevenths between them left out."""
    return F.regexp_extract(F.upper(c), r"(\d{2})\s*(?:\d/7)?\s*W(?:EE)?KS\s*AOG", 1).try_cast("int")
