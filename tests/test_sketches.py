"""Mergeable sketches: the merge of parts against the exact figures and against the sketch of the whole."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrivener.operators.sketches import Sketches


@pytest.mark.parametrize("counters", [8, 1000])
def test_merged_parts_keep_their_bounds(spark, counters):
    rng = random.Random(counters)
    rows = [(rng.choice("ab"), rng.randrange(9), rng.randrange(4000), round(rng.gauss(50, 20), 2), f"i{min(int(rng.expovariate(0.05)), 200)}") for _ in range(20_000)] + [("a", 3, None, None, None), ("c", 1, 1, 2.5, "only")]
    df = spark.createDataFrame(rows, "g string, day int, d int, x double, item string")
    s = Sketches("d", "x", "item", counters=counters)
    daily = s.partial(df, ["g"], F.col("day"))
    for days in ((0, 9), (2, 5)):
        got = {r["g"]: r for r in s.read(s.merged(daily.where(f"part >= {days[0]} and part < {days[1]}"), ["g"]), ["g"], (0.1, 0.5, 0.9)).collect()}
        some = [r for r in rows if days[0] <= r[1] < days[1]]
        assert set(got) == {r[0] for r in some}
        for g, r in got.items():
            own = [x for x in some if x[0] == g]
            assert r["n"] == len(own) and float(r["total"]) == pytest.approx(sum(x[3] or 0 for x in own))
            distinct, values, items = len({x[2] for x in own} - {None}), sorted(x[3] for x in own if x[3] is not None), Counter(x[4] for x in own if x[4])
            assert abs(r["n_distinct"] - distinct) <= max(1, 0.07 * distinct)
            for rank, q in zip((0.1, 0.5, 0.9), r["quantiles"]):
                assert sum(v < q for v in values) / len(values) - 0.04 <= rank <= sum(v <= q for v in values) / len(values) + 0.04
            found, slack = {x["item"]: x["count"] for x in r["frequent"]["items"]}, r["frequent"]["slack"]
            assert len(found) <= counters and all(0 <= n - found.get(i, 0) <= slack for i, n in items.items())
            assert slack == 0 if counters == 1000 else slack <= 2 * len(own) / counters + 1


def test_parts_in_any_grouping_merge_alike(spark):
    df = spark.range(3000).select((F.col("id") % 7).cast("int").alias("day"), F.col("id").alias("d"), (F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 30).cast("string").alias("item"))
    s = Sketches("d", "x", "item")
    daily = s.partial(df, [], F.col("day"))
    whole = s.read(s.merged(daily, []), []).first()
    twice = s.merged(daily.where("part < 3"), []).withColumn("part", F.lit(0)).unionByName(s.merged(daily.where("part >= 3"), []).withColumn("part", F.lit(1)))
    again = s.read(s.merged(twice, []), []).first()
    assert (whole["n"], whole["total"], whole["frequent"]) == (again["n"], again["total"], again["frequent"]) == (3000, whole["total"], again["frequent"])
    assert abs(whole["n_distinct"] - 3000) < 150 and abs(again["n_distinct"] - 3000) < 150 and abs(again["quantiles"][0] - 49.5) <= 4
    assert s.merged(daily.where("false"), ["part"]).count() == 0
