"""Table functions called from SQL, against the operators that they stand for."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from test_ladder import SCHEMA, attempts_of, expected

from scrivener import sqlfunctions
from scrivener.operators import ordered as W


@pytest.fixture(scope="module")
def sql(spark):
    sqlfunctions.register(spark)
    rows = [("a", i, None if i % 3 else f"v{i}") for i in range(40)] + [(None, i * i, "n") for i in range(5)] + [("b", 7, None)]
    spark.createDataFrame(rows, "k string, i long, v string").repartition(3).createOrReplaceTempView("t")
    return spark.sql


def test_fill_down_and_islands(spark, sql):
    t = spark.table("t")
    got = sql("SELECT * FROM fill_down(TABLE(t), 'v', 'i', 'k')")
    want = W.fill_down(t, ["k"], [F.col("i")], F.col("v"), F.col("v").isNull(), "filled")
    assert got.columns == want.columns and got.schema["filled"].dataType == t.schema["v"].dataType and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    got = sql("SELECT k, i, island FROM islands(TABLE(SELECT k, i FROM t), 'i', 2, 'k')")
    want = W.islands(t.select("k", "i"), ["k"], F.col("i"), 2).select("k", "i", "island")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert sql("SELECT * FROM fill_down(TABLE(SELECT * FROM t WHERE false), 'v', 'i', 'k')").count() == 0


def test_the_ladder(spark, sql):
    rows = attempts_of(6, 400)
    spark.createDataFrame([(a.strip().lower(), *r) for a, *r in rows], SCHEMA).createOrReplaceTempView("attempts")
    got = {r["i"]: (r["outcome"], r["attempts_left"], r["lock_seconds"]) for r in sql("SELECT * FROM sign_in_ladder(TABLE(attempts), 'at, i', 'right', 'name')").collect()}
    assert got == expected(rows)


def test_wrong_arguments_are_refused_at_analysis(sql):
    for call, why in (
        ("fill_down(TABLE(t), 'nope', 'i', 'k')", "no column nope"), ("fill_down(TABLE(t), 'v', 'i', NULL)", "constant text"), ("islands(TABLE(t), 'v', 2, 'k')", "is no number"), ("islands(TABLE(t), 'i', -1, 'k')", "0 or more"),
        ("fill_down(TABLE(SELECT *, 1 AS filled FROM t), 'v', 'i', 'k')", "has a column filled"), ("sign_in_ladder(TABLE(t), 'i', 'v', 'k')", "timestamp"),
    ):
        with pytest.raises(AnalysisException, match=why):
            sql(f"SELECT * FROM {call}")


@pytest.fixture
def short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, old)


def same(got, want):
    assert got.schema.simpleString() == want.schema.simpleString()
    rows = got.collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, want.collect()))
    return rows


FILLED = ["v", "cast(at as decimal(20, 2))", "array(at, null)", "struct(v, at as b)", "timestamp_micros(at)", "timestamp_ntz'2024-01-01 00:00:00'", "at % 2 = 0", "cast(v as binary)", "date_add(date'2024-01-01', cast(at as int))", "map(v, at)"]


def test_declared_functions_take_batches_of_many_keys(spark, sql, short_batches):
    t = spark.range(400).selectExpr(
        "CASE WHEN id % 7 > 0 THEN concat('k', id % 7) END AS k", "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') WHEN 2 THEN -0.0D WHEN 3 THEN 0.0D ELSE 1.5D END AS d",
        "id * 7919 % 1009 AS at", "concat('v', id) AS v", "id % 3 = 0 AS known",
    )
    for value in FILLED:
        view = t.selectExpr("k", "d", "at", f"CASE WHEN known THEN {value} END AS `the value`")
        view.createOrReplaceTempView("batches")
        for key in ("k", "d", "k, d") if value == "v" else ("k, d",):
            call = sqlfunctions.declare(spark, "declared", "fill_down", "batches", "the value", "at", key)
            same(sql(f"SELECT * FROM {call}"), W.fill_down(view, key.split(", "), [F.col("at")], F.col("the value"), F.col("the value").isNull(), "filled"))
    for kind in ("tinyint", "bigint", "float", "double", "decimal(12, 1)"):
        view = t.selectExpr("k", "d", f"CASE WHEN at % 9 > 0 THEN CAST(at % 100 AS {kind}) END AS `the place`")
        view.createOrReplaceTempView("batches")
        for key, gap in (("k", 2), ("d", 1), ("k, d", 4.5)):
            call = sqlfunctions.declare(spark, "declared", "islands", "batches", "the place", gap, key)
            assert max(r["island"] for r in same(sql(f"SELECT * FROM {call}"), W.islands(view, key.split(", "), F.col("`the place`"), gap))) > 3


def test_declared_islands_of_extreme_places(spark, sql, short_batches):
    """As the function that takes a row at a time says, whose numbers do not overflow."""
    big = 2**63
    longs = [-big, -big + 1, -1, 0, 5, 6, big - 2, big - 1, None]
    floats = [float("-inf"), -1e308, 0.0, 0.1, 0.3, 1e308, float("inf"), float("inf"), float("nan"), float("nan"), None]
    for kind, places, gaps in (("long", longs, (0, 1, 2.0**62, 3.7)), ("double", floats, (0, 0.1, 0.2))):
        spark.createDataFrame([(k, p) for k in (1, 2, None) for p in places], f"k int, p {kind}").createOrReplaceTempView("batches")
        for gap in gaps:
            call = sqlfunctions.declare(spark, "declared", "islands", "batches", "p", gap, "k")
            same(sql(f"SELECT * FROM {call}"), sql(f"SELECT * FROM islands(TABLE(batches), 'p', {gap}D, 'k')"))


def test_declared_functions_of_no_rows_and_of_wrong_arguments(spark, sql):
    sql("SELECT * FROM t WHERE false").createOrReplaceTempView("none")
    for function, arguments in (("fill_down", ("v", "i", "k")), ("islands", ("i", 2, "k"))):
        assert sql(f"SELECT * FROM {sqlfunctions.declare(spark, 'declared', function, 'none', *arguments)}").collect() == []
    sql("SELECT array(k) AS k, i, v FROM t").createOrReplaceTempView("lists")
    for function, view, arguments, why in (
        ("fill_down", "t", ("nope", "i", "k"), "no column nope"), ("fill_down", "t", ("v", "i", None), "constant text"), ("islands", "t", ("v", 2, "k"), "is no number"), ("islands", "t", ("i", -1, "k"), "0 or more"),
        ("islands", "lists", ("i", 2, "k"), "no key of plain values"),
    ):
        with pytest.raises(ValueError, match=why):
            sqlfunctions.declare(spark, "declared", function, view, *arguments)
