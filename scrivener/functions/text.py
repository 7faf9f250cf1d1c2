"""Text functions over columns: normal forms, keys, blanks, formats, tokens."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that handwriting readers mix up, folded alike before comparing.
FOLD_FROM, FOLD_TO = "V0Q1568", "UOOISGB"
EDGE_MARKS = ".,;:()"
DITTO = r"(?i)^\W*(?:do|ditto|same)?\W*$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value found once, however often ``use`` reads it (functions over arrays repeat what stands in them)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(c: Column) -> Column:
    """White space runs (Unicode ones too) as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def comparable(c: Column) -> Column:
    return F.upper(collapse(c))


def alnum_key(c: Column) -> Column:
    """Capitals and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def spaced_key(c: Column) -> Column:
    """Capitals and digits with single spaces for whatever stands between."""
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def folded_key(c: Column) -> Column:
    """``spaced_key`` without spaces and with look-alike letters folded."""
    return F.translate(F.replace(spaced_key(c), F.lit(" "), F.lit("")), FOLD_FROM, FOLD_TO)


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def first_filled(*cols: Column) -> Column:
    """The first value that is not blank, trimmed; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def field_normal(kind: Column, c: Column) -> Column:
    """Field-aware normal form: dates write / and . as -, codes write - as a space and then lose all spaces, others are ``comparable``."""
    plain = comparable(c)
    return (
        F.when(kind == "date", F.regexp_replace(plain, r"\s*[-/.]\s*", "-"))
        .when(kind == "code", F.regexp_replace(plain, r"[-\s]+", ""))
        .otherwise(plain)
    )


def edges(c: Column) -> Column:
    """Struct (before, core, after): marks at the ends of a word and what they enclose; a word of marks only is its own core."""
    marks = "[" + "".join("\\" + m for m in EDGE_MARKS) + "]*"
    pattern = rf"^({marks})(.*?)({marks})$"
    core = F.regexp_extract(c, pattern, 2)
    only = core == ""
    return F.struct(
        F.when(only, F.lit("")).otherwise(F.regexp_extract(c, pattern, 1)).alias("before"),
        F.when(only, c).otherwise(core).alias("core"),
        F.when(only, F.lit("")).otherwise(F.regexp_extract(c, pattern, 3)).alias("after"),
    )


def words_and_gaps(c: Column, *, split_marks: bool) -> Column:
    """Words of a text; with ``split_marks`` also where a mark joins two letters without a space."""
    joined = F.regexp_replace(c, r"(?<=\p{L})[.,;]+(?=\p{L})", ", ") if split_marks else c
    return F.split(joined, " ")


def like_case(original: Column, replacement: Column) -> Column:
    """``replacement`` in the case in which ``original`` is written: all capitals, none, or a leading one."""
    return (
        F.when((original == F.upper(original)) & original.rlike(r"\p{L}"), F.upper(replacement))
        .when((original == F.lower(original)) & original.rlike(r"\p{L}"), F.lower(replacement))
        .when(original == F.initcap(original), F.concat(F.upper(F.substring(replacement, 1, 1)), F.lower(F.substring(replacement, 2, 1 << 30))))
        .otherwise(replacement)
    )


def is_ditto(c: Column) -> Column:
    """True for ditto marks (``"``, ``-do-``, ``ditto``, dashes)."""
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False)) & F.coalesce(c.rlike(DITTO), F.lit(False))


def clean_name(c: Column, *, drop_digits: bool = True, keep_periods: bool = False) -> Column:
    """Name text with marks (and digits) taken out and single spaces."""
    allowed = r"\p{L}\p{M}'\- " + ("." if keep_periods else "") + ("" if drop_digits else "0-9")
    return collapse(F.regexp_replace(c, f"[^{allowed}]", " "))


def join_filled(*cols: Column, sep: str = " ") -> Column:
    """The values that are not blank, trimmed, joined by ``sep``."""
    return F.array_join(F.filter(F.transform(F.array(*cols), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), sep)


def strip_na(c: Column) -> Column:
    """Empty text where a form would say N/A, else the text."""
    return F.when(c.rlike(r"(?i)^\s*n\s*[/.]?\s*a\.?\s*$"), F.lit("")).otherwise(c)


def number_text(c: Column) -> Column:
    """Text of a number, without a fraction that says nothing (12.0 as 12)."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def bare_decimal(c: Column) -> Column:
    """Text of a decimal without trailing zeros."""
    t = c.cast("string")
    return F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)


def fill_template(template: Column, values: Column) -> Column:
    """``template`` with each {key} of a map put in; null unless all keys are known and filled."""
    done = F.aggregate(F.map_entries(values), template, lambda t, e: F.when(is_blank(e["value"]), t).otherwise(F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"])))
    return F.when(~done.rlike(r"\{\w+\}"), done)


def mobile_63(c: Column) -> Column:
    """A Philippine mobile number as +63 and ten digits; null if it is none."""
    digits = F.regexp_replace(c, r"\D", "")
    ten = F.regexp_extract(digits, r"^(?:63|0)?(9\d{9})$", 1)
    return F.when(ten != "", F.concat(F.lit("+63"), ten))


def is_email(c: Column) -> Column:
    """Offline format check of an address."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}$") & ~F.contains(c, F.lit("..")), F.lit(False))


def recode(c: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """``mapping`` applied to a column; other values become ``default`` (null)."""
    if not mapping:
        return default if default is not None else F.lit(None)
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.element_at(pairs, c)
    return F.coalesce(found, default) if default is not None else found
