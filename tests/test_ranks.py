"""Ranks and value frames over ranges against one window a key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrivener import registry
from scrivener.operators import ordered
from conftest import SF


def test_ranks_and_frames_against_windows(spark):
    rng = random.Random(3)
    values = [None, float("nan"), -2.5, 0.0, 1.0, 2.0, 2.5, 7.0, 9.5]
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(values)) for i in range(400)] + [(1000, "single", 3.0)] + [(1001 + i, "three", 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "i int, k string, v double").repartition(5)
    w, near = Window.partitionBy("k").orderBy("v"), Window.partitionBy("k").orderBy("v").rangeBetween(-2, 2)
    unique = Window.partitionBy("k").orderBy("v", "i")
    tied = df.select("i", F.cume_dist().over(w).alias("below"), F.percent_rank().over(w).alias("share"))
    assert {tuple(r) for r in ordered.ranks(df, ["k"], ["v"], 4).select("i", "below", "share").collect()} == {tuple(r) for r in tied.collect()}
    want = df.select("i", F.ntile(4).over(unique).cast("long").alias("tile"), F.cume_dist().over(unique).alias("below"), F.percent_rank().over(unique).alias("share"))
    assert {tuple(r) for r in ordered.ranks(df, ["k"], ["v", "i"], 4).select("i", "tile", "below", "share").collect()} == {tuple(r) for r in want.collect()}
    frames = df.select("k", "v", F.count("*").over(near).alias("n")).distinct()
    assert {repr(tuple(r)) for r in ordered.count_within(df, ["k"], "v", 2, "n").collect()} == {repr(tuple(r)) for r in frames.collect()}


def test_no_window_holds_a_whole_priority(spark):
    found = registry.QUERIES["w15_rank_frames"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ntile" not in plan.lower() and "RangeFrame, -1000" not in plan
