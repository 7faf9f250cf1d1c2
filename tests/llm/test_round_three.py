"""Quality by positive-unlabelled learning, periodic runs and spelling variants: against brute force, SQL and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from scrivener.llm import periods, quality, spelling
from scrivener.llm.queries import ORACLES, QUERIES, repeating

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# ---- 11: quality -------------------------------------------------------------------------------------
def test_risk_gradient_agrees_with_differences():
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(0, quality.most_cells(), 60))
    hot, p, u = quality.one_hot(cells), rng.random(len(cells)), rng.random(len(cells))
    p, u = p / p.sum(), u / u.sum()
    for scale, prior in ((0.1, 0.4), (3.0, 0.9)):
        w = rng.normal(0, scale, int(quality._BINS.sum()) + 1)
        found, negative, g = quality.risk_gradient(w, hot, p, u, prior)
        goal = (lambda r: -r[1]) if negative < 0 else (lambda r: r[0] + r[1])
        for k in rng.integers(0, len(w), 12).tolist() + [len(w) - 1]:
            step = np.zeros(len(w))
            step[k] = 1e-5
            up, down = (goal(quality.risk_gradient(w + s, hot, p, u, prior)) for s in (step, -step))
            assert g[k] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(2)
    for prior in (0.3, 0.6, 0.9):
        good, bad = rng.dirichlet(np.ones(40) * 0.3), rng.dirichlet(np.ones(40) * 0.3)
        p = rng.multinomial(40_000, good)
        u = rng.multinomial(200_000, prior * good + (1 - prior) * bad)
        best = np.log((good + 1e-9) / (bad + 1e-9))
        assert quality.class_prior(best, p, u) == pytest.approx(prior, abs=0.1)


def brute_features(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if not words:
        return (0.0,) * len(quality.FEATURES)
    n, raw = len(words), (text or "").encode()
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    count = lambda pattern: len(re.findall(pattern, raw))
    letters = count(rb"[A-Za-z]")
    return (
        float(n), sum(words[i] == words[i - 1] for i in range(1, n)) / n, len(set(words)) / min(n, 1000), 1 - len(set(lines)) / len(lines),
        count(rb"[#*$%&|<>!=~^_{}\[\]\\]") / n, count(rb"[A-Z]") / max(letters, 1), count(rb"[0-9]") / sum(map(len, words)), sum(map(len, words)) / n, count(rb"[.,]") / n,
    )


def brute_cell(text):
    at, place = 0, 1
    for value, edges in zip(brute_features(text), quality.FEATURES.values()):
        at += place * sum(value >= e for e in edges)
        place *= len(edges) + 1
    return at


def test_quality_query_against_brute_force(spark):
    """Cells, counts and scores by hand over the same rows; only the descent itself is shared."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in docs}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    p, u = Counter(), Counter()
    for d, t in docs:
        if not held[d]:
            (p if d in good else u)[brute_cell(t)] += 1
    cells = sorted(p.keys() | u.keys())
    model = quality.fit(np.array(cells), np.array([p[c] for c in cells]), np.array([u[c] for c in cells]))
    got = {r["doc_id"]: r for r in QUERIES["op11_pu_quality"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        c, z = brute_cell(t), model.bias
        for first, bins, place in zip(quality._FIRST, quality._BINS, quality._PLACE):
            z += model.weights[first + c // place % bins]
        assert got[d]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert got[d]["held_out"] == held[d] and got[d]["predicted"] == int(got[d]["score"] >= 0.7)


def test_quality_is_accurate_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    got = QUERIES["op11_pu_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, good, bad = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), F.avg(F.when(F.col("quality") == 0, F.col("predicted")))).first()
    assert right > 0.98 and good > 0.99 and bad < 0.1


def test_quality_edges(spark):
    texts = [None, "", " \n\t", "a", "Das ist ein Satz. " * 60, "x | " * 50, "W! " * 40, "Das ist ein Satz. " * 200_000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*texts, texts[4], texts[4]])] + [(None, "a", 7), (3, "a", 7), (3, "a", 7)], "doc_id long, text string, _cell int")
    celled = docs.withColumn("cell", quality.cell(F.col("text")))
    cells = [r["cell"] for r in celled.where("doc_id is not null").orderBy("doc_id").collect()]
    assert cells[0] == cells[1] == cells[2] == 0 and min(cells) >= 0 and max(cells) < quality.most_cells()
    labels = spark.createDataFrame([(4, 1), (8, 1), (8, 1), (9, 1), (None, 1), (5, 0), (6, None)], "doc_id long, quality int")
    model = quality.learn(celled, labels)
    got = {(r["doc_id"], r["text"]): r["s"] for r in celled.withColumn("s", quality.score(F.col("cell"), model)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[(8, texts[4])] > 0.5 > got[(5, texts[5])]
    none = quality.learn(celled.limit(0), labels)
    assert none.prior == 0.5 and celled.limit(0).withColumn("s", quality.score(F.col("cell"), none)).count() == 0
    assert quality.learn(celled, labels.where("quality = 0")).margins(np.array([0, 5])).tolist() == [0, 0]


# ---- 12: periodic runs -------------------------------------------------------------------------------
def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def odd_texts(rng):
    for _ in range(rng.randint(1, 8)):
        n, k = rng.choice([0, 1, 5, 6, 7, 8, 20, 60, 150]), rng.choice([1, 2, 3, 5, 40])
        w = [str(rng.randrange(k)) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        if n and rng.random() < 0.3:
            w[rng.randrange(n)] = "z"
        yield " ".join(w)


def test_runs_of_words_against_brute_force():
    rng = random.Random(5)
    for _ in range(800):
        texts = list(odd_texts(rng))
        for t, (n, found, rest) in zip(texts, periods.search(texts)):
            want = brute_runs(t.split())
            assert (n, list(zip(*found)), rest) == (len(t.split()), want, collapsed(t.split(), want))


def test_nested_and_overlapping_runs():
    inner = "a a a a a a b " * 5 + "c d " * 6 + "d d d d d d"
    (n, found, rest), = periods.search([inner])
    assert list(zip(*found)) == brute_runs(inner.split()) and len(found[0]) > 4
    fibonacci = ["x", "x y"]
    while len(fibonacci) < 12:
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    (_, found, _), = periods.search([fibonacci[-1]])
    assert list(zip(*found)) == brute_runs(fibonacci[-1].split())


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(8)
    for n in (1, 2, 30, 300):
        s = np.r_[rng.integers(0, 3, n), 99]
        sa, isa, levels = periods.suffix_array(s)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert sa.tolist() == want and isa[sa].tolist() == list(range(len(s)))
        lcp = periods.common_prefixes(sa, levels)
        for k in range(1, len(s)):
            a, b = s[want[k - 1] :].tolist(), s[want[k] :].tolist()
            assert lcp[k] == next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


def test_periodic_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    altered = 0
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            altered += 1
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert altered > 10 and sum(r["n_runs"] for r in got.values()) > 20


def test_periodic_edges(spark):
    texts = [None, "", " \n ", "a", "a " * 5, "a " * 6, "é b " * 7, "a b c d " * 50_000, "w\x85w x " * 9]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(5, "a " * 6, 2), (None, "b b b b b b", 3)], "doc_id long, text string, runs int")
    found = docs.select("*", periods.periodic_runs(F.col("text")).alias("r"))
    got = {(r["doc_id"], r["runs"]): r["r"] for r in found.collect()}
    assert [got[(i, 1)]["n_words"] for i in range(5)] == [0, 0, 0, 1, 5] and not any(got[(i, 1)]["runs"] for i in range(5))
    assert got[(0, 1)]["collapsed"] == "" and got[(0, 1)]["top"] is None
    assert got[(5, 1)]["runs"] == [(0, 6, 1)] == got[(5, 2)]["runs"] and got[(5, 1)]["collapsed"] == "a" and got[(None, 3)]["collapsed"] == "b"
    assert tuple(got[(6, 1)]["top"]) == (0, 7, 1, 7000) and tuple(got[(7, 1)]["top"]) == (0, 200_000, 4, 50_000_000) and got[(8, 1)]["runs"] == [(0, 18, 2)]
    assert found.limit(0).count() == 0
    same = repeating(spark.createDataFrame([(None, "a b")] + [(i, None) for i in range(40)] + [(i, " ") for i in range(40)], "doc_id long, text string"))
    assert same.where("text is null or text in (' ', 'a b')").count() == 81


# ---- 13: spelling variants ---------------------------------------------------------------------------
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [x for x in counts if x != w and one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root))
    return sorted(out, key=repr)


def edits(w, letters):
    for i in range(len(w) + 1):
        yield from (w[:i] + c + w[i:] for c in letters)
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            yield from (w[:i] + c + w[i + 1 :] for c in letters)


def test_near_words_share_a_merged_list():
    """For random dictionaries, every edit of a word leaves the grams that the word alone says it leaves."""
    rng = random.Random(3)
    for _ in range(60):
        letters, qmax = "abé"[: rng.randint(2, 3)], rng.choice([2, 3, 4, 5])
        ws = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 12))) for _ in range(30)]
        marked = [spelling.START + w + spelling.END for w in ws]
        n = Counter(p[i : i + q] for p in marked for q in range(2, qmax + 1) for i in range(len(p) - q + 1))
        grams = {g for g in n if len(g) == 2}
        for q in range(3, qmax + 1):
            grams |= {g for g in n if len(g) == q and g[:-1] in grams and n[g[:-1]] > 3}
        grams = frozenset(grams)
        for w in ws[:4]:
            of = lambda x, role: {m for r, _, _, m in spelling.unaffected(x, grams, 2, qmax) if r == role}
            total, hit = spelling.affected_bound(w, grams, 2, qmax)
            assert hit < total or len(w) < 2 * qmax - 2
            for t in set(edits(w, letters)) - {w}:
                mine, other = {0: "mm", 1: "mi", -1: "im"}[len(w) - len(t)]
                assert of(w, mine) & of(t, other)


@pytest.mark.parametrize("limit", [64, 1])
def test_variants_against_brute_force(spark, monkeypatch, limit):
    """With a limit of one word every list with more is merged again with the rest of the words."""
    monkeypatch.setattr(spelling, "LONG_LIST", limit)
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeñ") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    words = set(base) | {x for w in base for x in rng.sample(sorted(set(edits(w, "abñ"))), 6)} | {"a", "ab", "b", "aaaaaaa", "aaaaaaaa"}
    counts = {w: rng.choice([1, 4, 5, 6, 30, 150, 900]) for w in sorted(words)}
    data = [(w, n) for w, n in counts.items()] + [(None, 50), ("split", 2), ("split", 3)]
    counts["split"] = 5
    got = spelling.group_variants(spark.createDataFrame(data, "word string, n long"))
    kept = {w: n for w, n in counts.items() if n >= 5}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_variants(kept)
    assert any(r[3] != r[5] for r in brute_variants(kept) if r[3])


def test_a_hot_list_is_split(spark, monkeypatch):
    """Thousands of words that differ in the middle only, so that all share the grams of their ends."""
    rng = random.Random(4)
    words = {"aaaa" + "".join(rng.choice("bcdefgh") for _ in range(4)) + "zzzz" for _ in range(1500)}
    counts = {w: rng.choice([5, 40]) for w in sorted(words)}
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_variants(counts)


def test_words_are_counted_whole(spark):
    texts = [None, "", "Straße STRASSE straßen", "ÉCOLES écoles Écoles", "abcdef×÷ abc-def abcdefg1", "lettre " * 30_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "lettre", "x"), (5, "lettre", "x")], "doc_id long, text string, word string")
    got = dict(spelling.count_words(docs).groupBy("word").sum("n").collect())
    want = Counter(w for _, t, _ in [tuple(r) for r in docs.collect()] for w in (re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[A-Za-zÀ-ÿ]+", t or "")) if len(w) >= 6)
    assert got == want and got["lettre"] == 30_002
    cut = dict(spelling.count_words(docs, misspell=1).groupBy("word").sum("n").collect())
    assert cut["lettre"] == 1 and sum(cut.values()) < sum(got.values())
    assert spelling.group_variants(spelling.count_words(docs.limit(0))).count() == 0


def test_spelling_query_agrees_with_sql(spark, duck):
    got = QUERIES["op13_spelling_variants"](spark, SF)
    want = duck.sql(ORACLES["op13_spelling_variants"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


# ---- crowded bands of the pipeline's near duplicates -------------------------------------------------
@pytest.mark.parametrize("hot", [2000, 5])
def test_crowded_bands_are_split_and_lose_nothing(spark, monkeypatch, hot):
    """Many texts around one long passage, in groups of near copies: bands of the passage hold texts of all groups."""
    from scrivener.llm import similar

    monkeypatch.setattr(similar, "HOT_BAND", hot)
    rng = np.random.default_rng(23)
    passage = [f"p{x}" for x in range(200)]
    texts = []
    for group in range(25):
        own = [f"g{group}w{x}" for x in rng.integers(0, 999, int(rng.integers(60, 160)))]
        for changed in (0, 1, 3, 8):
            other = passage + own
            for at in rng.integers(0, len(other), changed):
                other[at] = f"x{rng.integers(0, 99)}"
            texts.append(" ".join(other))
    sets, root = [set(similar.shingle_set(t).tolist()) for t in texts], list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs, text="text", key="doc_id").collect()}
    assert got == dict(enumerate(root)) and len(near) > 60 and len(set(root)) > 5
