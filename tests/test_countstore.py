"""The bucketed store of counts and the join on signatures, against rebuilding and brute force."""

import os
import random
from collections import Counter
from difflib import SequenceMatcher
from itertools import accumulate
from math import ceil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrivener.operators import linkage, signatures
from scrivener.operators.countstore import CountStore
from scrivener.registry import QUERIES

SCHEMA = StructType().add("field", "string").add("value", "string").add("n", "long")


def store_of(path, buckets=16):
    return CountStore(str(path), SCHEMA, ["field", "value"], ["n"], buckets=buckets)


def delta(spark, counts):
    return spark.createDataFrame([(*k, n) for k, n in counts.items()], SCHEMA)


def held(store, spark):
    return {(r["field"], r["value"]): r["n"] for r in store.table(spark).collect()}


def files(path):
    return {b: sorted(f for f in os.listdir(path / b) if f.endswith(".parquet")) for b in os.listdir(path) if b.startswith("bucket=")}


def test_batches_add_up_and_repeats_change_nothing(spark, tmp_path):
    rng, store, total = random.Random(1), store_of(tmp_path / "s"), Counter()
    assert held(store, spark) == {}
    for batch in range(1, 6):
        part = {(rng.choice(["a", "b", None]), f"v{rng.randrange(40)}"): rng.randint(-3, 5) for _ in range(30)}
        assert store.apply(delta(spark, part), batch)
        for k, n in part.items():
            total[k] = max(0, total[k] + n)
        want = {k: n for k, n in total.items() if n}
        assert held(store, spark) == want
        before = files(tmp_path / "s")
        assert store.apply(delta(spark, part), batch) == [] and files(tmp_path / "s") == before and held(store, spark) == want
    assert store.apply(delta(spark, {}), 9) == []


def test_a_delta_leaves_other_buckets_alone(spark, tmp_path):
    store = store_of(tmp_path / "s")
    store.apply(delta(spark, {("f", f"v{i}"): 1 for i in range(400)}), 1)
    before = files(tmp_path / "s")
    touched = store.apply(delta(spark, {("f", "v7"): 2, ("f", "v8"): -1}), 2)
    after = files(tmp_path / "s")
    assert 1 <= len(touched) <= 2 and len(before) == 16
    assert {b for b in before if before[b] != after[b]} == {f"bucket={b}" for b in touched}
    assert held(store, spark)[("f", "v7")] == 3 and ("f", "v8") not in held(store, spark)


def test_a_batch_that_failed_half_way_is_finished_once(spark, tmp_path):
    """As after a writer that died when it had replaced some of the buckets."""
    first, second = {("f", f"v{i}"): 1 for i in range(60)}, {("f", f"v{i}"): 10 for i in range(60)}
    whole, broken = store_of(tmp_path / "whole"), store_of(tmp_path / "broken")
    for s in (whole, broken):
        s.apply(delta(spark, first), 1)
    whole.apply(delta(spark, second), 2)
    for b in list(files(tmp_path / "whole"))[:7]:
        for f in os.listdir(tmp_path / "broken" / b):
            os.remove(tmp_path / "broken" / b / f)
        for f in os.listdir(tmp_path / "whole" / b):
            (tmp_path / "broken" / b / f).write_bytes((tmp_path / "whole" / b / f).read_bytes())
    assert len(broken.apply(delta(spark, second), 2)) == 9
    assert held(broken, spark) == held(whole, spark) == {k: 11 for k in first}


def test_a_stream_feeds_the_store(spark, tmp_path):
    store, folder = store_of(tmp_path / "s"), str(tmp_path / "in")
    schema = "field string, value string"
    for rows in ([("a", "x")] * 3 + [("b", "y")], [("a", "x"), ("c", None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        counted = store.feed(lambda df: df.groupBy("field", "value").agg(F.count("*").alias("n")))
        spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(counted).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert held(store, spark) == {("a", "x"): 4, ("b", "y"): 1, ("c", None): 1}


def misread(rng, w):
    w = list(w)
    for _ in range(rng.randint(0, 3)):
        k, c = rng.randrange(len(w)), rng.choice("abcdeé ")
        rng.choice([lambda: w.insert(k, c), lambda: w.pop(k) if len(w) > 1 else None, lambda: w.__setitem__(k, c)])()
    return "".join(w)


@pytest.mark.parametrize("many", [20_000, 2])
def test_signatures_lose_no_similar_pair(spark, many):
    rng = random.Random(many)
    entries = sorted({"".join(rng.choice("aabcdeé") for _ in range(rng.randint(1, 14))) for _ in range(150)})
    texts = sorted({misread(rng, rng.choice(entries)) for _ in range(150)} | {"", "zzz"})
    right = spark.createDataFrame([(rng.choice("pq"), e) for e in entries], "k string, e string")
    left = spark.createDataFrame([(k, t) for t in texts for k in "pq"] + [("p", None), (None, "a")], "k string, t string")
    at = {r["e"]: r["k"] for r in right.collect()}
    for cutoff in (0.6, 0.75, 0.9):
        got = {(r["k"], r["t"], r["e"]) for r in signatures.similar_pairs(left, right, ["k"], "t", "e", cutoff, (F.col("size") - 3, F.col("size") + 3), many=many).collect()}
        alike = {(at[e], t, e) for t in texts for e in entries if t and abs(len(t) - len(e)) <= 3 and SequenceMatcher(None, t, e, autojunk=False).ratio() >= cutoff}
        assert alike <= got and len(got) < len(texts) * len(entries)


def test_nearest_common_word_against_brute_force(spark):
    rng = random.Random(6)
    entries = {"".join(rng.choice("ABCDEFGH") for _ in range(rng.randint(4, 10))): rng.randint(1, 9) for _ in range(120)}
    texts = sorted({misread(rng, w.lower()) for w in rng.sample(sorted(entries), 80)} | {"abcdef"})
    got = linkage.near_entry(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame(list(entries.items()), "e string, n int"), [], "t", "e", "n", 0.8)
    for r in got.collect():
        t = r["t"].upper()
        fit = [(-SequenceMatcher(None, t, e).ratio(), -n, e) for e, n in entries.items() if abs(len(e) - len(t)) <= max(2, len(t) // 4)]
        best = min((f for f in fit if -f[0] >= 0.8), default=None)
        want = None if t in entries or best is None else best[2]
        assert r["nearest"] == want and (want is None or r["nearest_score"] == pytest.approx(-best[0]))


def test_short_texts_pair_only_where_enough_letters_stand_in_order(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(8, 13)))
    left, right = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            row = [0, *accumulate(zip(row, row[1:], y), lambda m, z: max(m, z[1], z[0] + (c == z[2])), initial=0)][1:]
        return row[-1]

    frames = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((left, "t"), (right, "e")))
    got = {(r["t"], r["e"]) for r in signatures.similar_pairs(*frames, [], "t", "e", 0.85, (F.col("size") - 3, F.col("size") + 3)).collect()}
    want = {(x, y) for x in left for y in right if abs(len(x) - len(y)) <= 3 and common(x, y) >= ceil(0.85 * (len(x) + len(y)) / 2 - 1e-9)}
    assert got == want and len(want) > 5


def test_without_a_band_entries_of_all_lengths_that_the_cutoff_allows_are_found(spark):
    rng = random.Random(8)
    entries = {"".join(rng.choice("ABCDEFGH") for _ in range(rng.randint(1, 24))): rng.randint(1, 9) for _ in range(120)}
    less = lambda w: "".join(w[k] for k in sorted(rng.sample(range(len(w)), len(w) - len(w) // 4)))
    texts = sorted({f(w) for w in entries for f in (less, lambda w: w + less(w)[: len(w) // 3], lambda w: misread(rng, w).upper())})
    frames = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame(list(entries.items()), "e string, n int")
    for cutoff in (0.6, 0.85):
        got = {r["t"]: (r["nearest"], r["nearest_score"]) for r in linkage.near_entry(*frames, [], "t", "e", "n", cutoff, band=False).collect()}
        want, far = {}, 0
        for t in texts:
            fit = [(-s, -n, e) for e, n in entries.items() if (s := SequenceMatcher(None, t, e).ratio()) >= cutoff]
            best = None if t in entries else min(fit, default=None)
            want[t] = (best and best[2], best and -best[0])
            far += bool(best) and abs(len(best[2]) - len(t)) > max(2, len(t) // 4)
        assert got == want and far > 5


def test_rare_word_finds_a_common_word_three_letters_longer(spark, tmp_path):
    texts = ["andanblehein"] * 10 + ["ananbleen", "andanblehe", "qqqqqqqqq"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["word"]: (r["nearest"], r["nearest_score"]) for r in QUERIES["j08_rare_words"](spark, str(tmp_path)).collect()}
    assert got == {"ananbleen": ("andanblehein", 18 / 21), "andanblehe": ("andanblehein", 20 / 22), "qqqqqqqqq": (None, None)}
