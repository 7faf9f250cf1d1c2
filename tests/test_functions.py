"""Functions on small fixtures: each case states what it must give."""

import datetime

import pytest
from pyspark.sql import functions as F

from scrivener.functions import dates as D
from scrivener.functions import metrics as M
from scrivener.functions import names as N
from scrivener.functions import text as X
from scrivener.functions.similarity import clue_score, similarity
from scrivener.operators import learning as L
from scrivener.operators import linkage as K
from scrivener.operators import stores as S
from scrivener.sources import sinks, tables


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_dates(spark):
    d = datetime.date
    cases = {
        "09/14/2026": d(2026, 9, 14), "2026-09-14": d(2026, 9, 14), "9-4-68": d(2068, 9, 4), "9-4-69": d(1969, 9, 4), "September 4, 2026": d(2026, 9, 4), "Sep 4 2026": d(2026, 9, 4),
        "O8-2I-26": d(2026, 8, 21), "05-21-20 10.COAM": d(2020, 5, 21), "92-h1-b0": d(2026, 9, 14), "02-31-2020": None, "0F-11-20": None, "": None, None: None,
    }
    assert one(spark, list(cases), D.parse_date) == list(cases.values())


def test_dates_that_the_column_cannot_hold(spark):
    as_of = F.lit("2026-10-01").cast("date")
    birth = lambda c: D.parse_date(c, F.lit("birth"), as_of)
    event = lambda c: D.parse_date(c, F.lit("event"), as_of)
    assert one(spark, ["01-02-2030", "01-02-1999"], birth) == [None, datetime.date(1999, 1, 2)]
    assert one(spark, ["01-02-2019", "09-30-2026"], event) == [None, datetime.date(2026, 9, 30)]


def test_times(spark):
    cases = {"1;20pm": ("13:20", "PM"), "12:05 AM": ("00:05", "AM"), "10DDAM": ("10:00", "AM"), "13:45": ("13:45", None), "0:00AM": (None, None), "08.20.26": (None, None), None: (None, None), "25:10": (None, None)}
    got = one(spark, list(cases), D.parse_time)
    assert [(g["clock"], g["half"]) for g in got] == list(cases.values())


def test_ages(spark):
    df = spark.sql("select date'2020-02-29' b, date'2021-02-28' o, date'2019-01-01' e")
    assert df.select(D.age_years(F.col("b"), F.col("o")), D.age_days(F.col("b"), F.col("e"))).first()[:] == (0, None)


def test_names(spark):
    cases = {
        "DELA CRUZ, JUAN MIGUEL": ("DELA CRUZ", "JUAN", "MIGUEL", None), "JUAN DELA CRUZ, JR": ("DELA CRUZ", "JUAN", None, "JR"), "MARY ANN DENISE ALCANTARA": ("ALCANTARA", "MARY ANN", "DENISE", None),
        "MARY MABEL": ("MABEL", "MARY", None, None), "DELA CRUZ JR., JUAN": ("DELA CRUZ", "JUAN", None, "JR"), "MARIA DE LOS SANTOS": ("DE LOS SANTOS", "MARIA", None, None), "SINGLE": ("SINGLE", None, None, None), " ": (None,) * 4, None: (None,) * 4,
    }
    got = one(spark, list(cases), N.split_name)
    assert [(g["last"], g["first"], g["middle"], g["suffix"]) for g in got] == list(cases.values())


def test_newborn_after_a_comma(spark):
    names = ["QUIADO, BB GIRL", "QUIADO,BBYBOI", "BABY BOY REYES, ANA", "DELA CRUZ , BB B0Y", "REYES, ANA", ",", "", None, "BBY GRL DELA CRUZ", "BABYGIRL"]
    assert one(spark, names, N.newborn) == ["BABY GIRL", "BABY BOY", "BABY BOY", "BABY BOY", None, None, None, None, "BABY GIRL", "BABY GIRL"]
    assert one(spark, names, N.clean_newborn) == ["QUIADO, BABY GIRL", "QUIADO, BABY BOY", "BABY BOY REYES, ANA", "DELA CRUZ, BABY BOY", "REYES, ANA", ",", "", None, "BABY GIRL DELA CRUZ", "BABY GIRL"]


def test_newborn(spark):
    assert one(spark, ["8ABY GIRI CRUZ", "BB. B0Y X", "13ABY GIRL", "MARY", None], N.newborn) == ["BABY GIRL", "BABY BOY", "BABY GIRL", None, None]


def test_text(spark):
    assert one(spark, ["a  b\n", "", None], X.collapse) == ["a b", "", None]
    assert one(spark, ["-do-", '"', "ditto", "", None, "Dona"], X.is_ditto) == [True, True, True, False, False, False]
    assert [tuple(x) for x in one(spark, ["(Davao,", "...", "x"], X.edges)] == [("(", "Davao", ","), ("", "...", ""), ("", "x", "")]
    assert one(spark, ["a@b.co", "a..b@c.de", "x@y", None], X.is_email) == [True, False, False, False]
    assert one(spark, ["0917 123 4567", "+639171234567", "12"], X.mobile_63) == ["+639171234567", "+639171234567", None]
    assert one(spark, ["n/a", "N.A.", "Ana", ""], X.strip_na) == ["", "", "Ana", ""]


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("", "x"), ("one two", ""), ("same", "same")], "t string, r string")
    got = [tuple(r) for r in df.select(M.cer(F.col("t"), F.col("r")), M.wer(F.col("t"), F.col("r")), M.char_accuracy(F.col("t"), F.col("r"))).collect()]
    assert got == [(1 / 5, 1 / 3, pytest.approx(80.0)), (None, None, 0.0), (1.0, 1.0, 0.0), (0.0, 0.0, 100.0)]


def test_ratios_and_f1(spark):
    r = spark.sql("select 1 a, 0 b").select(M.percent(F.col("a"), F.col("b")), M.f1(F.lit(None).cast("double"), F.lit(1.0)), M.f1(F.lit(0.0), F.lit(1.0)), M.f1(F.lit(0.5), F.lit(0.5))).first()
    assert r[:] == (None, None, 0.0, 0.5)


def test_similarity_is_gestalt(spark):
    df = spark.createDataFrame([("PUOK", "PUROK"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(similarity(F.col("a"), F.col("b"))).collect()] == [pytest.approx(8 / 9), None, 1.0]
    assert clue_score("PSI", "FORPSIREMOUAL") == 0.9 and clue_score("UISIT", "UISIT") == 1.0 and clue_score("PSI", "FOO") == 0.0 and clue_score("", "A") == 0.0


def test_counting_and_uncounting_agree_with_a_recount(spark):
    old, new = (spark.createDataFrame(r, "k string, n long") for r in ([("a", 2), ("b", 1)], [("b", 3), ("c", 1)]))
    both = S.counting_upsert(old, new, ["k"], ["n"])
    assert {tuple(r) for r in both.collect()} == {("a", 2), ("b", 4), ("c", 1)}
    assert {tuple(r) for r in S.uncount(both, new, ["k"], "n").where("n > 0").select("k", "n").collect()} == {("a", 2), ("b", 1)}
    gone = spark.createDataFrame([("a", 9)], "k string, n long")
    assert S.uncount(old, gone, ["k"], "n").where("k = 'a'").first()["n"] == 0
    assert {tuple(r) for r in S.changes(new, old, ["k"], "n").collect()} == {("a", 0, 2), ("b", 2, 0), ("c", 1, 0)}


def test_unchanged_readings_suppress_a_correction(spark):
    counts = spark.createDataFrame([("S", "Street", 3), ("S", "S", 3), ("T", "Tree", 1), ("U", "Ugly", 6), ("U", "U", 4)], "wrong string, correct string, n long")
    assert [tuple(r) for r in L.supported_mode(counts, ["wrong"], "correct").collect()] == [("U", "Ugly", 6, 10)]


def test_vote_ties_and_blanks(spark):
    r = spark.createDataFrame([(1, "Abc", 0.5), (1, "ABC", 0.4), (1, "x", 0.9), (1, " ", 5.0), (1, None, 5.0), (2, "q", 0.5), (2, "p", 0.5)], "id int, t string, c double")
    got = {x["id"]: (x["text"], x["votes"]) for x in L.weighted_vote(r, ["id"], "t", "c").collect()}
    assert got == {1: ("x", 1), 2: ("p", 1)} or got == {1: ("Abc", 2), 2: ("p", 1)}


def test_near_entry_finds_what_brute_force_finds(spark):
    from difflib import SequenceMatcher

    words = ["CABANTIAN", "CARSANTAN", "CABANTAN", "DAVAO", "DAUAO", "PUROK", "PUOK", "BUHANGIN", "BUHANGI", "X"]
    known = [("CABANTIAN", 5), ("DAVAO", 9), ("PUROK", 3), ("BUHANGIN", 2)]
    left = spark.createDataFrame([("A", w) for w in words], "c string, t string")
    right = spark.createDataFrame([("A", e, n) for e, n in known], "c string, e string, n int")
    got = {r["t"]: r["nearest"] for r in K.near_entry(left, right, ["c"], "t", "e", "n", 0.8).collect()}
    for w in words:
        fits = [(SequenceMatcher(None, w, e).ratio(), n, e) for e, n in known if abs(len(e) - len(w)) <= max(2, len(w) // 4)]
        best = max((f for f in fits if f[0] >= 0.8), default=None)
        assert got[w] == (None if w in dict(known) or best is None else best[2]), w


def test_forward_only(spark):
    ladder = ["draft", "ready", "exported"]
    df = spark.createDataFrame([("draft", "ready"), ("exported", "draft"), ("ready", "odd"), ("odd", "odd")], "a string, b string")
    assert [r[0] for r in df.select(S.forward_only(ladder, F.col("a"), F.col("b"))).collect()] == ["ready", "exported", "ready", None]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿key,kind\nx,A\n,B\n y ,B\n", encoding="utf-8")
    assert [tuple(r) for r in tables.csv_table(spark, str(tmp_path / "a.csv"), "key string, kind string", key="key", allowed={"kind": ["A", "B"]}).collect()] == [("x", "A"), ("y", "B")]
    with pytest.raises(Exception, match="unknown value"):
        tables.csv_table(spark, str(tmp_path / "a.csv"), "key string, kind string", key="key", allowed={"kind": ["A"]}).collect()
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "1.json").write_text('{"a": 1}')
    (docs / "2.json").write_text("{broken")
    assert [(r["a"], r["file_name"]) for r in tables.json_folder(spark, str(docs), "a int").collect()] == [(1, "1.json")]
    assert sinks.sheet_names(["a/b", "a:b", "x" * 40]) == ["a_b", "a_b_2", "x" * 31]
    assert one(spark, ["1-3,7", "all", "2"], tables.row_ranges) == [[1, 2, 3, 7], None, [2]]
    with pytest.raises(ValueError, match="secret"):
        tables.whitelist(spark.createDataFrame([(1, 2)], "a int, secret int"), ["a"])


def test_cascade_delete(spark):
    parents, children = spark.createDataFrame([(1,), (2,), (3,)], "p int"), spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "c int, p int")
    left, kept = S.cascade_delete(parents, children, spark.createDataFrame([(10,), (12,)], "c int"), "c", "p")
    assert {r["p"] for r in left.collect()} == {1, 3} and {r["c"] for r in kept.collect()} == {11}
