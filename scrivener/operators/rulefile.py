"""Rules as data: a table of conditions compiled into one array expression, with what is wrong with it reported by row."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StructType

from .rules import BLOCK, RISK, WARN, Rule

#: Columns of a rule table. Rows with one id are conditions that must all hold for the rule to be broken.
COLUMNS = ("id", "category", "severity", "scope", "field", "operator", "operand", "message")
RULE_TABLE = ", ".join(f"{c} string" for c in COLUMNS)
#: More conditions than this are no rule table; it is read by the driver.
MOST_CONDITIONS = 5_000
SEVERITIES = (BLOCK, WARN, RISK)

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Problem:
    """A row of the table (numbered from 1) that is no condition, and why."""

    row: int
    id: str | None
    why: str


class _Bad(ValueError):
    pass


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def _literal(text: str, kind: DataType, df: DataFrame) -> Column:
    """An operand as a value of a field's type: numbers, dates and booleans must read as such."""
    t, name = text.strip(), kind.simpleString()
    if isinstance(kind, NumericType):
        if not re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", t):
            raise _Bad(f"{text!r} is no number")
        return F.lit(t).cast("double" if re.search(r"[.eE]", t) and not name.startswith("decimal") else name)
    if name == "boolean":
        if t.lower() not in ("true", "false"):
            raise _Bad(f"{text!r} is neither true nor false")
        return F.lit(t.lower() == "true")
    if name.startswith(("date", "timestamp")):
        if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])( \d\d:\d\d:\d\d)?", t):
            raise _Bad(f"{text!r} is no date")
        return F.lit(t).cast(name)
    if name != "string":
        raise _Bad(f"fields of type {name} have no operands")
    return F.lit(text)


def _condition(row, schema: StructType, df: DataFrame) -> Column:
    fields = {f.name: f.dataType for f in schema}
    if row["field"] not in fields:
        raise _Bad(f"unknown field {row['field']!r}")
    kind, c, operator, operand = fields[row["field"]], F.col(f"`{row['field']}`"), (row["operator"] or "").strip().lower(), row["operand"]
    if operator in ("blank", "filled"):
        if operand not in (None, ""):
            raise _Bad(f"{operator} takes no operand")
        return _blank(c) if operator == "blank" else ~_blank(c)
    if operand is None:
        raise _Bad(f"{operator or 'an operator'} needs an operand")
    if operator in _COMPARE:
        if operand.startswith("@"):  # another field
            if operand[1:] not in fields:
                raise _Bad(f"unknown field {operand[1:]!r}")
            if isinstance(kind, NumericType) != isinstance(fields[operand[1:]], NumericType):
                raise _Bad(f"{row['field']} and {operand[1:]} are not of a kind")
            return _COMPARE[operator](c, F.col(f"`{operand[1:]}`"))
        return _COMPARE[operator](c, _literal(operand, kind, df))
    if operator in ("in", "not in"):
        found = c.isin(*[_literal(x, kind, df) for x in operand.split("|")])
        return found if operator == "in" else ~found
    if operator == "between":
        ends = operand.split("|")
        if len(ends) != 2:
            raise _Bad("between needs two ends")
        return c.between(*[_literal(x, kind, df) for x in ends])
    if operator in ("matches", "lacks"):
        try:
            re.compile(operand)
        except re.error as e:
            raise _Bad(f"pattern {operand!r}: {e}") from e
        return c.cast("string").rlike(operand) if operator == "matches" else ~c.cast("string").rlike(operand)
    raise _Bad(f"unknown operator {row['operator']!r}")


def compile_rules(table: DataFrame, df: DataFrame) -> tuple[list[Rule], list[Problem]]:
    """The rules of a table (``COLUMNS``) for rows like those of ``df``, in order of their first row, and the rows that are no conditions.

    Operators: ``= <> < <= > >=`` (an operand ``@name`` is another field), ``in`` and ``not in``
    (values between ``|``), ``between`` (two values), ``matches`` and ``lacks`` (a pattern),
    ``blank`` and ``filled``. Operands must read as the field's type. A rule with a bad row is
    left out as a whole; a row without id, with an unknown severity, or unlike the first
    of its id in category, severity, scope or message is bad. Nothing of an operand is ever parsed as SQL.
    """
    # a rule table is small by its bound; more rows than that are refused
    rows = table.select(*[F.col(c).cast("string") for c in COLUMNS]).limit(MOST_CONDITIONS + 1).collect()
    if len(rows) > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} conditions")
    problems, heads, conditions, bad = [], {}, {}, set()
    for i, row in enumerate(rows, 1):
        try:
            if not (row["id"] or "").strip():
                raise _Bad("no id")
            head = tuple(row[c] for c in ("category", "severity", "scope", "message"))
            if row["severity"] not in SEVERITIES:
                raise _Bad(f"unknown severity {row['severity']!r}")
            if heads.setdefault(row["id"], head) != head:
                raise _Bad("unlike the first row of this rule")
            conditions.setdefault(row["id"], []).append(_condition(row, df.schema, df))
        except _Bad as e:
            problems.append(Problem(i, row["id"], str(e)))
            bad.add(row["id"])
    rules = []
    for name, (category, severity, scope, message) in heads.items():
        if name not in bad:
            broken = conditions[name][0]
            for c in conditions[name][1:]:
                broken = broken & c
            rules.append(Rule(name, category or "", severity, broken, message or "", tuple(s for s in (scope or "").split("|") if s)))
    return rules, problems


def read_rules(spark, path: str) -> DataFrame:
    """A rule table from CSV with a header; all columns are text, blank operands are null."""
    return spark.read.schema(RULE_TABLE).csv(path, header=True, enforceSchema=False)


def write_rules(spark, rows: Sequence[Sequence[str | None]], path: str) -> str:
    spark.createDataFrame([tuple(r) for r in rows], RULE_TABLE).coalesce(1).write.csv(path, header=True)
    return path
