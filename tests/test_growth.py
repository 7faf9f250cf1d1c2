"""Shapes of plans that let queries grow with their tables: no exploded table sent to the driver, much work a row dealt out."""

import pytest
from conftest import SF

import scrivener.registry as registry
from scrivener.operators import stores


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_between_pages_sends_no_lines_to_the_driver(spark):
    found = plan(registry.QUERIES["j22_rows_between_pages"](spark, SF))
    assert "SortMergeJoin" in found and "Broadcast" not in found


@pytest.mark.parametrize("name", ["x25_offset_search", "x27_regular_lines", "f21_split_name"])
def test_much_work_a_row_is_dealt_out_over_all_partitions(spark, name):
    assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["r01_order_features", "r02_compiled_rules", "r09_field_graph"])
def test_lines_are_not_multiplied_for_distinct_counts(spark, name):
    assert "Expand" not in plan(registry.QUERIES[name](spark, SF))


def test_lines_are_sorted_once(spark):
    assert plan(registry.QUERIES["r02_compiled_rules"](spark, SF)).split("Initial Plan")[-1].count("Sort [l_orderkey") == 1


def test_rows_without_parent_do_not_meet_in_one_task(spark):
    rows = spark.range(1000).selectExpr("id AS claim", "'other' AS role", "CAST(NULL AS BIGINT) AS parent")
    wanted = spark.range(1000).selectExpr("id AS claim", "'mother' AS role", "CASE WHEN id = 7 THEN 5000 WHEN id = 8 THEN 3 END AS parent")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        parts = stores.checked_links(rows, "claim", wanted, ("mother",)).rdd.glom().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {r["claim"]: (r["role"], r["parent"], r["error"]) for p in parts for r in p}
    assert max(map(len, parts)) < 500 and len(got) == 1000
    assert got[7] == ("other", None, "no such parent") and got[8] == ("mother", 3, None) and got[9] == ("mother", None, None)


@pytest.mark.parametrize("name", ["q01_sql_fill_down", "q02_sql_islands"])
def test_table_functions_take_batches_not_rows(spark, name):
    found = plan(registry.QUERIES[name](spark, SF))
    assert "ArrowEvalPythonUDTF" in found and "BatchEvalPythonUDTF" not in found
