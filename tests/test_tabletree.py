"""Two versions of a table compared through their digests."""

import random
from collections import Counter

import pytest

from scrivener.operators import tabletree as T

SCHEMA = "k string, i int, v string"


def brute(a, b):
    out = {}
    for key in {r[:2] for r in a} | {r[:2] for r in b}:
        x, y = (Counter(r for r in rows if r[:2] == key) for rows in (a, b))
        gone, come = sum((x - y).values()), sum((y - x).values())
        if gone or come:
            out[key] = ("missing" if not y else "extra" if not x else "changed", max(gone, come))
    return out


def trees(spark, tmp_path, *versions):
    return [T.TableTree(str(tmp_path / f"v{n}"), ("k", "i")).write(spark.createDataFrame(rows, SCHEMA)) for n, rows in enumerate(versions)]


def test_changes_are_found_with_their_multiplicity(spark, tmp_path):
    rng = random.Random(2)
    old = [(rng.choice(["a", "b", None]), rng.randrange(300), rng.choice(["x", "y", None, ""])) for _ in range(900)]
    new = [r for r in old if rng.random() > 0.02]
    new = [(k, i, "z") if rng.random() < 0.02 else (k, i, v) for k, i, v in new] + [("n", i, "x") for i in range(5)] + old[:3]
    a, b = trees(spark, tmp_path, old, new)
    got = {(r["k"], r["i"]): (r["kind"], r["n"]) for r in T.compare(spark, a, b).collect()}
    assert got == brute(old, new) and {k for k, _ in got.values()} == {"missing", "extra", "changed"}


def test_only_differing_leaves_are_read(spark, tmp_path):
    old = [("k", i, "x") for i in range(4000)]
    new = [*old[:17], ("k", 17, "changed"), *old[18:]]
    a, b = trees(spark, tmp_path, old, new)
    leaves = T.differing_leaves(spark, a, b)
    assert len(leaves) == 1
    assert len(a.rows(spark, leaves).inputFiles()) > 0 and a.rows(spark, leaves).count() < 80
    plan = T.compare(spark, a, b)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and str(leaves[0]) in plan
    assert [tuple(r) for r in T.compare(spark, a, b).collect()] == [("k", 17, "changed", 1)]


def test_equal_empty_and_unlike_trees(spark, tmp_path):
    rows = [("k", 1, "x"), ("k", 1, "x"), (None, None, None)]
    a, b = trees(spark, tmp_path, rows, rows[::-1])
    assert T.differing_leaves(spark, a, b) == [] and T.compare(spark, a, b).count() == 0
    (empty,) = trees(spark, tmp_path / "e", rows[:1])
    assert {(r["kind"], r["n"]) for r in T.compare(spark, a, empty).collect()} == {("changed", 1), ("missing", 1)}
    with pytest.raises(ValueError, match="unlike"):
        T.differing_leaves(spark, a, T.TableTree("x", ("k",)))


def test_rows_are_hashed_by_value_place_of_nulls_and_sign_of_zero(spark, tmp_path):
    df = spark.createDataFrame([(0.0, "x", None), (-0.0, "x", None), (0.0, None, "x"), (None, "x", None), (0.0, "x", "")], "a double, b string, c string")
    assert all(df.select(h.alias("h")).distinct().count() == 5 for h in T.row_hashes(df.schema))
