"""Derived fields in layers, and rules compiled from a table."""

import pytest
from pyspark.sql import functions as F

from scrivener.operators import derived as D
from scrivener.operators import rulefile as L
from scrivener.operators import rules as R


def test_layers_follow_needs_in_any_order():
    fields = [D.Field("d", ("c", "x"), "c + x"), D.Field("c", ("a", "b"), "a + b"), D.Field("b", ("a",), "a + 1"), D.Field("a", ("x",), "x * 2")]
    assert [[f.name for f in layer] for layer in D.layers(fields, ["x"])] == [["a"], ["b"], ["c"], ["d"]]
    assert D.layers([], ["x"]) == []
    with pytest.raises(ValueError, match="a -> c -> b -> a|b -> a -> c -> b|c -> b -> a -> c"):
        D.layers([D.Field("a", ("c",), "c"), D.Field("b", ("a",), "a"), D.Field("c", ("b",), "b"), D.Field("e", ("a",), "a")], [])
    with pytest.raises(ValueError, match="a -> a"):
        D.layers([D.Field("a", ("a",), "a")], [])
    with pytest.raises(ValueError, match="unknown needs.*nowhere"):
        D.layers([D.Field("a", ("nowhere",), "nowhere")], ["x"])
    with pytest.raises(ValueError, match="twice"):
        D.layers([D.Field("a", (), "1"), D.Field("a", (), "2")], [])
    chain = [D.Field(f"f{i}", (f"f{i - 1}" if i else "x",), "x") for i in range(3000)]
    assert len(D.layers(chain[::-1], ["x"])) == 3000


def test_touched_fields_stay_and_others_follow_them(spark):
    fields = [D.Field("c", ("b",), "b * 10"), D.Field("b", ("a",), "a + 1"), D.Field("a", ("x",), "x * 2")]
    rows = [(1, None, None, None), (2, ["b"], 100, None), (3, ["a", "c"], None, 7), (4, [], 5, 5), (None, ["zzz"], None, None)]
    df = spark.createDataFrame(rows, "x int, touched array<string>, b int, c int")
    got = {r["x"]: (r["a"], r["b"], r["c"]) for r in D.derive(df, fields, "touched").collect()}
    assert got == {1: (2, 3, 30), 2: (4, 100, 1000), 3: (None, None, 7), 4: (8, 9, 90), None: (None, None, None)}
    assert D.derive(df, fields).where("x = 2").first()["c"] == 50
    plan = D.derive(df, fields, "touched")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


HEAD = ["id", "category", "severity", "scope", "field", "operator", "operand", "message"]


def test_rules_from_a_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0, "ab", "2024-01-02", True), (2, -1.0, " ", "2020-05-06", False), (3, None, None, None, None)], "k int, x double, s string, d string, f boolean").withColumn("d", F.to_date("d"))
    good = [
        ("neg", "c", R.BLOCK, "", "x", "<", "0", "m"), ("old", "c", R.WARN, "a|b", "d", "<", "2021-01-01", "m"), ("both", "c", R.BLOCK, "", "x", ">=", "5", "m"), ("both", "c", R.BLOCK, "", "s", "matches", "^a", "m"),
        ("none", "c", R.RISK, "", "s", "blank", None, "m"), ("pick", "c", R.WARN, "", "k", "in", "2|3", "m"), ("span", "c", R.WARN, "", "k", "between", "1|2", "m"), ("cross", "c", R.WARN, "", "k", ">", "@x", "m"),
        ("yes", "c", R.WARN, "", "f", "=", "true", "m"), ("quote", "c", R.WARN, "", "s", "=", "x' OR '1'='1", "m"),
    ]
    table = L.read_rules(spark, L.write_rules(spark, good, str(tmp_path / "rules")))
    rules, problems = L.compile_rules(table, df)
    assert problems == [] and [r.name for r in rules] == ["neg", "old", "both", "none", "pick", "span", "cross", "yes", "quote"]
    names = lambda scope=None: {r["k"]: [x["rule"] for x in r["fired"]] for r in R.run_rules(df, rules, scope).collect()}
    assert names() == {1: ["both", "span", "yes"], 2: ["neg", "old", "none", "pick", "span", "cross"], 3: ["none", "pick"]}
    assert "old" not in names("z")[2] and "old" in names("b")[2]
    assert R.run_rules(df.limit(0), rules).count() == 0 and L.compile_rules(table.limit(0), df) == ([], [])


def test_bad_rows_are_reported_and_their_rules_left_out(spark):
    bad = [
        ("ok", "c", R.WARN, "", "k", "=", "1", "m"), (None, "c", R.WARN, "", "k", "=", "1", "m"), ("a", "c", "shout", "", "k", "=", "1", "m"), ("b", "c", R.WARN, "", "nope", "=", "1", "m"), ("d", "c", R.WARN, "", "k", "like", "1", "m"),
        ("e", "c", R.WARN, "", "k", "=", "1); DROP", "m"), ("g", "c", R.WARN, "", "s", "matches", "(", "m"), ("h", "c", R.WARN, "", "k", "between", "1", "m"), ("i", "c", R.WARN, "", "k", "blank", "x", "m"), ("j", "c", R.WARN, "", "k", "=", None, "m"),
        ("l", "c", R.WARN, "", "k", "<", "@s", "m"), ("two", "c", R.WARN, "", "k", "=", "1", "m"), ("two", "c", R.BLOCK, "", "k", "=", "2", "m"), ("n", "c", R.WARN, "", "d", ">", "2024-13-01", "m"),
    ]
    df = spark.createDataFrame([(1, "a")], "k int, s string").withColumn("d", F.current_date())
    rules, problems = L.compile_rules(spark.createDataFrame(bad, L.RULE_TABLE), df)
    assert [r.name for r in rules] == ["ok"] and [p.row for p in problems] == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14]
    assert "no number" in problems[4].why and "pattern" in problems[5].why and "unlike the first" in problems[10].why
    with pytest.raises(ValueError, match="more than"):
        L.compile_rules(spark.range(L.MOST_CONDITIONS + 1).select(*[F.lit("x").alias(c) for c in HEAD]), df)


def test_fill_down_over_ranges_equals_the_window(spark):
    """A key with most rows, keys of one row, null keys, ranges without any value: as one window over the key."""
    import random

    from scrivener.operators import ordered as W

    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 30 + ["a", None]), i, rng.choice([None, None, "x", "y", f"v{i}"])) for i in range(3000)]
    rows += [("hot", i, None) for i in range(3000, 4000)] + [(f"k{i}", i, "z") for i in range(4000, 4050)]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for own, default in ((True, None), (False, F.lit("none"))):
            for keys in (["k"], []):
                args = (F.col("v"), F.col("v") == "y")
                got = W.fill_down_ranges(df, keys, ["i"], *args, "f", own=own, default=default)
                want = W.fill_down(df, keys, [F.col("i")], *args, "f", own=own, default=default)
                assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        parts = W.fill_down_ranges(df, [], ["i"], F.col("v"), F.lit(False), "f").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert W.fill_down_ranges(df.limit(0), ["k"], ["i"], F.col("v"), F.lit(False), "f").count() == 0
