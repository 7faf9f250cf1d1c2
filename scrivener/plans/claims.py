"""Features of an order with its lines and customer, rules from a file over them, and a graph of derived fields."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import derived as D
from ..operators import rulefile as L
from ..operators import rules as R
from ..sources.sinks import scratch
from .base import query

_LINES = {
    "n_lines": "count(*)", "n_parts": "count(DISTINCT l_partkey)", "n_suppliers": "count(DISTINCT l_suppkey)", "quantity": "sum(CAST(l_quantity AS BIGINT))", "most_quantity": "max(l_quantity)", "least_quantity": "min(l_quantity)",
    "lines_price": "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)", "most_price": "max(l_extendedprice)", "least_price": "min(l_extendedprice)", "most_discount": "max(l_discount)", "most_tax": "max(l_tax)",
    "n_returned": "sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", "n_accepted": "sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)", "n_open_lines": "sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)",
    "n_heavy": "sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END)", "n_free": "sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END)", "first_ship": "CAST(min(l_shipdate) AS DATE)", "last_ship": "CAST(max(l_shipdate) AS DATE)",
}


def _features(days) -> dict[str, str]:
    """Features by name in SQL that both engines read; ``days(a, b)`` says the days from a to b."""
    given = {"status": "o_orderstatus", "priority": "o_orderpriority", "date": "o_orderdate", "customer": "c_name", "segment": "c_mktsegment", "lines": "n_lines"}
    blank = {k: f"coalesce(trim(CAST({c} AS VARCHAR(99))), '') = ''" for k, c in given.items()}
    counts = {c: f"coalesce({c}, 0)" for c in _LINES if c.startswith("n_") or c == "quantity"}
    return {
        **{f"{k}_present": f"CASE WHEN {b} THEN 0 ELSE 1 END" for k, b in blank.items()},
        "blank_count": " + ".join(f"CASE WHEN {b} THEN 1 ELSE 0 END" for b in blank.values()),
        "order_year": "CAST(year(o_orderdate) AS INT)", "order_month": "CAST(month(o_orderdate) AS INT)", "order_day": "CAST(day(o_orderdate) AS INT)", "priority_number": "CAST(substr(o_orderpriority, 1, 1) AS INT)",
        "is_open": "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END", "is_final": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END", "is_pending": "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END",
        "total": "o_totalprice", "total_band": "CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'high' END", "name_length": "CAST(length(c_name) AS INT)", "name_number": "CAST(substr(c_name, 10, 9) AS BIGINT)",
        "balance": "c_acctbal", "owes": "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END", "segment": "upper(trim(c_mktsegment))", **counts,
        "most_quantity": "most_quantity", "least_quantity": "least_quantity", "lines_price": "coalesce(lines_price, 0.0)", "most_price": "most_price", "least_price": "least_price", "most_discount": "most_discount", "most_tax": "most_tax",
        "repeated_parts": "coalesce(n_lines - n_parts, 0)", "days_to_first": days("CAST(o_orderdate AS DATE)", "first_ship"), "days_to_last": days("CAST(o_orderdate AS DATE)", "last_ship"), "days_shipping": days("first_ship", "last_ship"),
        "ships_early": "CASE WHEN first_ship < CAST(o_orderdate AS DATE) THEN 1 ELSE 0 END", "over_total": "CASE WHEN lines_price > o_totalprice THEN 1 ELSE 0 END",
        "returned_all": "CASE WHEN n_returned = n_lines THEN 1 ELSE 0 END", "open_against_status": "CASE WHEN o_orderstatus = 'F' AND n_open_lines > 0 THEN 1 ELSE 0 END",
    }


_DUCK = _features(lambda a, b: f"CAST(date_diff('day', {a}, {b}) AS INT)")
_BASE = f"""li AS (SELECT l_orderkey, {", ".join(f"{e} AS {c}" for c, e in _LINES.items())} FROM lineitem GROUP BY 1),
 f AS (SELECT o_orderkey, {", ".join(f"{e} AS {c}" for c, e in _DUCK.items())} FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey)"""


def over(aggregate: str):
    """An aggregate of ``_LINES`` (casts around it stay outside) over the lines of an order."""
    return F.expr(re.sub(r"(sum|min|max|count)\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"\1(\2) OVER (PARTITION BY l_orderkey)", aggregate, count=1))


_LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def line_sums(t):
    """``_LINES`` by order. Lines are dealt out by order and sorted once: all sums are taken along that sort, which the join with the orders then uses too.

    ``count(DISTINCT)`` would send each line three times, sums by part of an order are wider than its
    lines, and a sort for each distinct count and one for the join hold the lines several times.
    """
    lines, order = t.lineitem.select(*_LINE_COLUMNS).where("l_orderkey is not null").repartition("l_orderkey"), Window.partitionBy("l_orderkey")
    by_part = order.orderBy("l_partkey")
    new_part = (F.col("l_partkey").isNotNull() & ~F.col("l_partkey").eqNullSafe(F.lag("l_partkey").over(by_part))).cast("long")
    distinct = {"n_parts": F.sum("_new_part").over(order), "n_suppliers": F.size(F.collect_set("l_suppkey").over(order)).cast("long")}
    marked = lines.select("*", new_part.alias("_new_part"), F.row_number().over(by_part).alias("_place"))
    summed = marked.select("l_orderkey", "_place", *[(distinct[c] if c in distinct else over(e)).alias(c) for c, e in _LINES.items()])
    return summed.where("_place = 1").drop("_place")


def features(t):
    """One row an order: 45 features from three whole tables; lines are added up before the join."""
    lines = line_sums(t)
    whole = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return whole.select("o_orderkey", *[F.expr(e).alias(c) for c, e in _features(lambda a, b: f"datediff({b}, {a})").items()])


@query("r01_order_features", f"WITH {_BASE} SELECT * FROM f")
def _(t):
    return features(t)


#: Rules: id, category, severity, scope, then conditions (field, operator, operand), the message, and the same in SQL.
RULES = [
    ("MF-01", "Missing", R.BLOCK, "", [("status_present", "=", "0")], "no status", "status_present = 0"),
    ("MF-02", "Missing", R.BLOCK, "", [("priority_present", "=", "0")], "no priority", "priority_present = 0"),
    ("MF-03", "Missing", R.BLOCK, "", [("date_present", "=", "0")], "no date", "date_present = 0"),
    ("MF-04", "Missing", R.BLOCK, "", [("customer_present", "=", "0")], "no customer", "customer_present = 0"),
    ("MF-05", "Missing", R.WARN, "", [("segment_present", "=", "0")], "no segment", "segment_present = 0"),
    ("MF-06", "Missing", R.BLOCK, "cf2", [("lines_present", "=", "0")], "no lines", "lines_present = 0"),
    ("MF-07", "Missing", R.RISK, "", [("blank_count", ">", "1")], "several blanks", "blank_count > 1"),
    ("MF-08", "Missing", R.WARN, "", [("most_tax", "blank", None), ("lines_present", "=", "1")], "no tax", "most_tax IS NULL AND lines_present = 1"),
    ("FT-01", "Format", R.BLOCK, "", [("name_length", "<>", "18")], "odd name", "name_length <> 18"),
    ("FT-02", "Format", R.WARN, "", [("segment", "lacks", "^[A-Z]+$")], "odd segment", "NOT regexp_matches(segment, '^[A-Z]+$')"),
    ("FT-03", "Format", R.WARN, "", [("priority_number", "not in", "1|2|3|4|5")], "odd priority", "priority_number NOT IN (1, 2, 3, 4, 5)"),
    ("FT-04", "Format", R.BLOCK, "", [("total_band", "in", "low|high"), ("n_lines", ">=", "6")], "odd total", "total_band IN ('low', 'high') AND n_lines >= 6"),
    ("DT-01", "Dates", R.BLOCK, "", [("ships_early", "=", "1")], "shipped before it was ordered", "ships_early = 1"),
    ("DT-02", "Dates", R.WARN, "", [("days_to_first", ">", "365")], "late", "days_to_first > 365"),
    ("DT-03", "Dates", R.WARN, "cf2|cf4", [("days_shipping", ">", "730")], "long", "days_shipping > 730"),
    ("DT-04", "Dates", R.BLOCK, "", [("order_year", "<", "1996"), ("is_open", "=", "1")], "old and open", "order_year < 1996 AND is_open = 1"),
    ("DT-05", "Dates", R.BLOCK, "", [("days_to_last", "<", "@days_to_first")], "dates crossed", "days_to_last < days_to_first"),
    ("DT-06", "Dates", R.WARN, "", [("order_month", "=", "12"), ("order_day", ">=", "24")], "holidays", "order_month = 12 AND order_day >= 24"),
    ("DT-07", "Dates", R.WARN, "", [("order_day", "between", "29|31")], "end of month", "order_day BETWEEN 29 AND 31"),
    ("AM-01", "Amounts", R.BLOCK, "", [("total", "<=", "0")], "no total", "total <= 0"),
    ("AM-02", "Amounts", R.BLOCK, "", [("over_total", "=", "1"), ("is_final", "=", "1")], "lines over total", "over_total = 1 AND is_final = 1"),
    ("AM-03", "Amounts", R.WARN, "", [("most_discount", ">=", "0.1")], "great discount", "most_discount >= 0.1"),
    ("AM-04", "Amounts", R.WARN, "", [("most_price", ">", "90000.5")], "dear line", "most_price > 90000.5"),
    ("AM-05", "Amounts", R.BLOCK, "", [("least_quantity", "<", "1")], "no quantity", "least_quantity < 1"),
    ("AM-06", "Amounts", R.WARN, "", [("quantity", ">", "200")], "great quantity", "quantity > 200"),
    ("AM-07", "Amounts", R.BLOCK, "", [("owes", "=", "1"), ("total_band", "=", "high")], "owes and orders much", "owes = 1 AND total_band = 'high'"),
    ("AM-08", "Amounts", R.WARN, "", [("balance", "<", "-500")], "owes much", "balance < -500"),
    ("AM-09", "Amounts", R.BLOCK, "", [("lines_price", ">", "@total"), ("n_heavy", ">", "2")], "heavy and over total", "lines_price > total AND n_heavy > 2"),
    ("CN-01", "Consistency", R.BLOCK, "", [("open_against_status", "=", "1")], "open lines of a final order", "open_against_status = 1"),
    ("CN-02", "Consistency", R.BLOCK, "", [("returned_all", "=", "1"), ("is_final", "<>", "1")], "all returned, not final", "returned_all = 1 AND is_final <> 1"),
    ("CN-03", "Consistency", R.WARN, "", [("repeated_parts", ">", "0")], "a part twice", "repeated_parts > 0"),
    ("CN-04", "Consistency", R.WARN, "", [("n_suppliers", "<", "@n_lines")], "a supplier twice", "n_suppliers < n_lines"),
    ("CN-05", "Consistency", R.BLOCK, "cf4", [("n_free", "=", "@n_lines"), ("n_lines", ">", "1")], "all without discount", "n_free = n_lines AND n_lines > 1"),
    ("CN-06", "Consistency", R.BLOCK, "", [("is_pending", "=", "1"), ("n_accepted", ">", "3")], "accepted while pending", "is_pending = 1 AND n_accepted > 3"),
    ("CN-07", "Consistency", R.BLOCK, "", [("name_number", ">=", "0"), ("name_length", "filled", None), ("priority_number", "=", "1"), ("is_open", "=", "1"), ("n_open_lines", "=", "0")], "urgent, open, nothing open", "priority_number = 1 AND is_open = 1 AND n_open_lines = 0"),
]
_FIRED = "list_filter([" + ", ".join(f"CASE WHEN {r[6]} THEN '{r[0]}' END" for r in RULES) + "], lambda x: x IS NOT NULL)"
_WITH = lambda severity: ", ".join(f"'{r[0]}'" for r in RULES if r[2] == severity)


@query("r02_compiled_rules", f"WITH {_BASE}, x AS (SELECT o_orderkey, {_FIRED} AS rules FROM f) SELECT o_orderkey, rules, len(list_filter(rules, lambda r: r IN ({_WITH(R.BLOCK)})))::INTEGER AS n_critical, len(list_filter(rules, lambda r: r IN ({_WITH(R.WARN)})))::INTEGER AS n_warning FROM x")
def _(t):
    """35 rules, written to a CSV file and compiled from it into one expression over the features."""
    rows = [(r[0], r[1], r[2], r[3], *c, r[5]) for r in RULES for c in r[4]]
    found = features(t)
    rules, problems = L.compile_rules(L.read_rules(t.spark, L.write_rules(t.spark, rows, scratch(t.spark, "rules"))), found)
    if problems:
        raise ValueError(problems)
    run = R.run_rules(found, rules)
    return run.select("o_orderkey", F.transform("fired", lambda x: x["rule"]).alias("rules"), "n_critical", "n_warning")


def _graph(days) -> list[D.Field]:
    f = lambda name, needs, sql: D.Field(name, tuple(needs.split()), sql)
    return [
        f("ordered", "o_orderdate", "CAST(o_orderdate AS DATE)"), f("due", "ordered", "CAST(ordered + INTERVAL 30 DAY AS DATE)"), f("closing", "due", "CAST(due + INTERVAL 10 DAY AS DATE)"), f("reminder", "due", "CAST(due - INTERVAL 7 DAY AS DATE)"),
        f("days_open", "ordered closing", days("ordered", "closing")), f("days_left", "reminder closing", days("reminder", "closing")), f("order_year", "ordered", "CAST(year(ordered) AS INT)"), f("order_month", "ordered", "CAST(month(ordered) AS INT)"),
        f("due_year", "due", "CAST(year(due) AS INT)"), f("crosses_year", "order_year due_year", "order_year <> due_year"), f("half", "order_month", "CASE WHEN order_month <= 6 THEN 1 ELSE 2 END"), f("season", "order_month", "CASE WHEN order_month IN (12, 1, 2) THEN 'cold' WHEN order_month IN (6, 7, 8) THEN 'warm' ELSE 'mild' END"),
        f("period", "order_year half", "CONCAT(CAST(order_year AS VARCHAR(4)), '-', CAST(half AS VARCHAR(1)))"), f("rank_of_priority", "o_orderpriority", "CAST(substr(o_orderpriority, 1, 1) AS INT)"), f("urgent", "rank_of_priority", "rank_of_priority <= 2"),
        f("grace", "urgent", "CASE WHEN urgent THEN 0 ELSE 5 END"), f("last_call", "closing grace", "CASE WHEN grace = 0 THEN closing ELSE CAST(closing + INTERVAL 5 DAY AS DATE) END"), f("days_to_call", "ordered last_call", days("ordered", "last_call")),
        f("client", "c_name", "upper(trim(c_name))"), f("client_number", "client", "substr(client, 10, 9)"), f("client_key", "client_number", "CAST(client_number AS BIGINT)"), f("client_parity", "client_key", "CASE WHEN client_key % 2 = 0 THEN 'even' ELSE 'odd' END"),
        f("segment", "c_mktsegment", "lower(c_mktsegment)"), f("segment_code", "segment", "substr(segment, 1, 3)"), f("label", "segment_code client_number", "CONCAT(segment_code, '-', client_number)"), f("reference", "label period", "CONCAT(label, '/', period)"),
        f("owes", "c_acctbal", "c_acctbal < 0"), f("lines", "n_lines", "coalesce(n_lines, 0)"), f("many", "lines", "lines > 4"), f("small", "lines", "lines BETWEEN 1 AND 2"), f("average", "quantity lines", "CASE WHEN lines > 0 THEN CAST(floor(quantity / lines) AS BIGINT) END"),
        f("size_class", "many small", "CASE WHEN many THEN 'large' WHEN small THEN 'small' ELSE 'usual' END"), f("shipped_by", "last_ship", "last_ship"), f("late_days", "shipped_by due", days("due", "shipped_by")), f("late", "late_days", "late_days > 0"),
        f("very_late", "late_days grace", "late_days > 365 + grace"), f("blocked", "owes very_late", "owes AND coalesce(very_late, false)"), f("route", "blocked urgent late", "CASE WHEN blocked THEN 'stop' WHEN urgent THEN 'fast' WHEN late THEN 'chase' ELSE 'plain' END"),
        f("desk", "route segment_code", "CONCAT(route, ':', segment_code)"), f("title", "reference desk size_class", "CONCAT(reference, ' ', desk, ' ', size_class)"),
    ]


_TOUCHED = {"due": "CAST(TIMESTAMP '2001-02-03 00:00:00' AS DATE)", "season": "'typed'", "urgent": "true"}
_G = _graph(lambda a, b: f"CAST(date_diff('day', {a}, {b}) AS INT)")
#: The fields as written, each reading those before it, which DuckDB allows in one list.
_COMPUTED = ", ".join(f"CASE WHEN o_orderkey % 5 = {i} THEN {_TOUCHED[g.name]} ELSE {g.sql} END AS {g.name}" if (i := list(_TOUCHED).index(g.name) if g.name in _TOUCHED else None) is not None else f"{g.sql} AS {g.name}" for g in _G)


@query("r09_field_graph", f"""WITH li AS (SELECT l_orderkey, {", ".join(f"{e} AS {c}" for c, e in _LINES.items())} FROM lineitem GROUP BY 1),
 b AS (SELECT orders.*, customer.*, li.* FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey), g AS (SELECT o_orderkey, {_COMPUTED} FROM b) SELECT o_orderkey, {", ".join(g.name for g in _G)} FROM g""")
def _(t):
    """40 fields; a fifth of the orders each have typed values for ``due``, ``season`` and ``urgent``, which stay."""
    lines = line_sums(t)
    whole = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    typed = whole.withColumns({name: F.expr(value) for name, value in _TOUCHED.items()})
    touched = F.filter(F.array(*[F.when(F.col("o_orderkey") % 5 == i, F.lit(name)) for i, name in enumerate(_TOUCHED)]), lambda x: x.isNotNull())
    fields = _graph(lambda a, b: f"datediff({b}, {a})")
    # in an order that is not that of the needs, as a form would list them
    found = D.derive(typed.withColumn("touched", touched), sorted(fields, key=lambda x: x.name), "touched")
    return found.select("o_orderkey", *[g.name for g in fields])
