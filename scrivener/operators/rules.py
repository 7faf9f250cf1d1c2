"""Table-driven rules: each a name, category, severity, scope and predicate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, WARN, RISK = "block_submission", "display_warning", "flag_high_risk"


@dataclass(frozen=True)
class Rule:
    """``broken`` is true where the rule is violated; null counts as not violated."""

    name: str
    category: str
    severity: str
    broken: Column
    message: str = ""
    scopes: tuple[str, ...] = ()


def fired(rules: Iterable[Rule], scope: str | None = None) -> Column:
    """Array of structs (rule, category, severity, message) of the rules that a row breaks, in the given order."""
    parts = [
        F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message")))
        for r in rules
        if scope is None or not r.scopes or scope in r.scopes
    ]
    empty = "array<struct<rule: string, category: string, severity: string, message: string>>"
    return F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast(empty)


def run_rules(df: DataFrame, rules: Sequence[Rule], scope: str | None = None) -> DataFrame:
    """``df`` with ``fired``, ``n_critical``, ``n_warning`` and ``can_generate`` (nothing critical)."""
    out = df.withColumn("fired", fired(rules, scope))
    count = lambda s: F.size(F.filter("fired", lambda x: x["severity"] == s))
    return out.withColumn("n_critical", count(BLOCK)).withColumn("n_warning", count(WARN)).withColumn("can_generate", F.col("n_critical") == 0)


def required(columns: Sequence[str], scope: str = "") -> list[Rule]:
    """A blocking rule a column that must not be blank."""
    return [Rule(f"{c}_missing", "required", BLOCK, F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"{c} is required", (scope,) if scope else ()) for c in columns]


def route(confidence: Column, accept: float = 0.85, review: float = 0.65) -> Column:
    """accepted, needs_check or manual_encoding_required, by confidence (null: manual)."""
    return F.when(confidence.isNull() | (confidence < review), "manual_encoding_required").when(confidence < accept, "needs_check").otherwise("accepted")


def field_status(confidence: Column, blank: Column, ditto: Column, incomplete: Column, must_have: Column) -> Column:
    """Routing with two safety rules: blank and ditto cells are empty unless the column must be filled, and incomplete readings are never accepted."""
    status = route(confidence)
    return F.when((blank | ditto) & ~must_have, "empty").when((status == "accepted") & incomplete, "needs_check").otherwise(status)


def box_check(fmt: Column, expected: Column, shown: Column) -> Column:
    """Whether a shown value is the expected one under its format: exact, digits, text (case and spacing aside) or number."""
    return (
        F.when(fmt == "digits", F.regexp_replace(expected, r"\D", "") == F.regexp_replace(shown, r"\D", ""))
        .when(fmt == "text", F.upper(F.trim(F.regexp_replace(expected, r"\s+", " "))) == F.upper(F.trim(F.regexp_replace(shown, r"\s+", " "))))
        .when(fmt == "number", expected.try_cast("double") == shown.try_cast("double"))
        .otherwise(expected == shown)
    )
