"""The corpus pipeline: each stage on its own input, and the whole run."""

import corpus_pipeline as pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from scrivener.llm import language
from scrivener.llm.common import held_out

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "source_mix"]
    n = docs.count()
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "source_mix":
            assert out.columns == docs.columns and out.schema == docs.schema or out.columns == docs.columns
            assert n * 0.8 <= out.count() <= n
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_decisions_take_effect(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    plain = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 400 and 900 and lang = 'en'").orderBy("doc_id").limit(8).collect()]
    secret = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    texts = [*plain, plain[0], "12345 !!", None, plain[1] + "\n" + item, f'{plain[2]} token = "{secret}" the end', *[f"{plain[3]} number {k}4371549438645904" for k in range(3)]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)
    stages = dict(pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert set(range(len(texts))) - ids(stages["language_id"](spark, docs, SF)) == {9, 10}
    gone = set(range(len(texts))) - ids(stages["near_dedup"](spark, docs, SF))
    assert 8 in gone and not gone & set(range(8))
    assert set(range(len(texts))) - ids(stages["decontamination"](spark, docs, SF)) == {11}
    masked = {r["doc_id"]: r for r in stages["secret_scan"](spark, docs, SF).collect()}
    assert len(masked) == len(texts) and secret not in masked[12]["text"] and masked[12]["n_chars"] == len(masked[12]["text"]) and masked[0]["text"] == plain[0]


def test_near_copies_go_as_by_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    for n in (6, 30, 150, 400):
        base = [f"w{x}" for x in rng.integers(0, 10_000, n)]
        texts.append(" ".join(base))
        for changed in (0, 1, 1, 2, 4, 8, 16):  # words changed, from exact copies to far ones
            other = list(base)
            for at in rng.integers(0, n, changed):
                other[at] = f"x{at}"
            texts.append(" ".join(other))
    passage = " ".join(f"p{x}" for x in range(60))
    texts += [passage + " " + " ".join(f"v{x}" for x in rng.integers(0, 10_000, 40)) for _ in range(12)] + ["", None, "a b", "A  b", "a c"]

    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"] for r in dict(pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()}
    assert got == {i for i, r in enumerate(root) if i == r} and len(got) < len(texts) - 10


def test_stages_of_crowded_tables_with_repeated_rows(spark):
    plain = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 300 and 900").orderBy("doc_id").limit(12).collect()]
    texts = [*plain, plain[0], None, "", "12345 !!", "w " * 200_000]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "s", len(t or "")) for i, t in enumerate(texts)], DOC)
    docs = docs.union(docs.where("doc_id < 3"))
    wide = docs.withColumns({c: F.lit("own") for c in "_lid _hits _row _secrets _mark _place _key value path label n component_id".split()})
    for name, stage in pipeline.STAGES:
        narrow, out = stage(spark, docs, SF), stage(spark, wide, SF)
        key = sorted(str(r["doc_id"]) for r in narrow.collect())
        assert key == sorted(str(r["doc_id"]) for r in out.collect()) and key
        if name != "source_mix":
            assert out.columns == wide.columns and {r["_lid"] for r in out.select("_lid").collect()} == {"own"}


def test_language_stage_and_mix_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify(docs, docs.where(~held_out("doc_id"))).collect()
    want = {r["doc_id"] for r in found if r["_lid"]["lang"] != "und" and r["_lid"]["margin"] >= pipeline.LANGUAGE_MARGIN}
    stages = dict(pipeline.STAGES)
    assert {r["doc_id"] for r in stages["language_id"](spark, docs, SF).collect()} == want
    sizes = {}
    for r in docs.collect():
        sizes.setdefault(r["source"], []).append(len((r["text"] or "").split()))
    whole = {s: sum(x) for s, x in sizes.items()}
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(whole, key=lambda s: (s is None, s)))}
    targets, open_ = {}, set(whole)
    while True:
        level = (sum(whole.values()) - sum(targets.values())) / sum(weights[s] for s in open_)
        if not (over := {s for s in open_ if weights[s] * level >= 3 * whole[s]}):
            break
        targets |= {s: 3 * whole[s] for s in over}
        open_ -= over
    targets |= {s: weights[s] * level for s in open_}
    taken = {}
    for r in stages["source_mix"](spark, docs, SF).collect():
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.01 * targets[s] + 5 for s in targets)


def test_run_mixes_what_the_stages_kept(spark):
    out = pipeline.run(spark, SF)
    got = out.agg(F.count("*").alias("n"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.sum("taken").alias("taken")).first()
    assert got["n"] > 100 and got["most"] <= 3 and got["least"] >= 1 and got["taken"] > 0
