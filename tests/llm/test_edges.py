"""Repeated rows and very long texts for operators whose other tests have none."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from scrivener.llm import licenses, mixing, rules, substrings, toxicity, warc

DOC = "doc_id long, text string, source string"


def test_repeated_rows_of_toxicity(spark):
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 20)) for _ in range(120)]
    toxic = [" ".join([*rng.choice(["alpha", "beta"], 10), "vile", "foul"]) for _ in range(40)]
    rows = [(i, t, "s") for i, t in enumerate(clean + toxic)]
    docs = spark.createDataFrame(rows + rows[:30] + rows[-20:], DOC)
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(0, 160, 2)] * 2, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == 210 and len({(r["doc_id"], r["s"]) for r in got}) == 160
    assert min(r["s"] for r in got if r["doc_id"] >= 120) > max(r["s"] for r in got if r["doc_id"] < 120)


def test_repeated_rows_of_host_rules_count_each(spark):
    row = (1, 5, 0, "h")
    flags = spark.createDataFrame([row, row, (2, 50, 0, "h"), (3, 50, 0, "g"), (3, 50, 0, "g")], "doc_id long, n_words long, n_repeat_words long, source string")
    got = rules.judge(flags, host="source").collect()
    assert len(got) == 5 and len({tuple(r) for r in got}) == 3
    rates = {r["source"]: (r["n_docs"], r["n_failed"]) for r in rules.host_rates(flags.withColumn("base_failed", rules.base_failed()), host="source").collect()}
    assert rates == {"h": (3, 2), "g": (2, 0)}


def test_repeated_rows_of_a_mix(spark):
    rows = [(i % 40, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, DOC), mixing.by_turns(1, 2)).collect()
    assert len(got) == 200 and all(0 <= r["copies"] <= mixing.MAX_REPEATS for r in got)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 1


def test_repeated_rows_of_a_license_scan(spark):
    row = (7, "Released under the MIT License.", "s")
    got = licenses.scan(spark.createDataFrame([row, row, (8, "nothing of the kind here", "s")], DOC)).collect()
    assert len(got) >= 2 and {r["doc_id"] for r in got} == {7} and len({tuple(r) for r in got}) * 2 == len(got)


def test_very_long_texts(spark):
    rng = np.random.default_rng(8)
    words = rng.integers(0, 10**7, 300_000)
    long = " ".join(map(str, words.tolist())) + "\n# $"
    docs = spark.createDataFrame([(1, long, "a"), (2, "short text here", "a"), (3, None, "b")], DOC)
    counts = {r["doc_id"]: r["c"] for r in docs.select("doc_id", rules.text_counts(F.col("text")).alias("c")).collect()}
    assert counts[1]["n_words"] == 300_002 and counts[1]["n_symbols"] == 2 and counts[3]["n_words"] == 0
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(docs, mixing.by_turns(1, 2)).collect()}
    assert sizes == {1: 300_002, 2: 3, 3: 0}
    copied = spark.createDataFrame([(1, long), (2, long[1000:1_200_000])], "doc_id long, text string")
    left = {r["doc_id"]: r for r in substrings.remove_repeats(copied).collect()}
    assert (left[1]["n_removed"], left[2]["n_removed"], left[2]["n_bytes"]) == (0, 1_199_000, 1_199_000)
    assert left[1]["kept_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    pages = spark.createDataFrame([(1, "http://x.example/", long * 8)], "page_id long, url string, html string")
    back = warc.record_digests(warc.read_chunks(warc.write_archives(warc.record_chunks(pages), warc.archive_folder(spark)), with_data=False)).first()
    assert back["payload_bytes"] == 8 * len(long) and back["record_type"] == "response"
