"""The correction cascade on small fixtures."""

from pyspark.sql import functions as F

from scrivener.operators import correction as C


def test_cascade_order(spark):
    df = spark.createDataFrame(
        [(1, "A", "CASANTANDAVAO"), (2, "A", "hilltap Road"), (3, "A", "HILLTOP RAOD"), (4, "A", "exact fix"), (5, "A", None), (6, "A", " "), (7, "B", "HILLTAP"), (8, "A", "Hilltop 12"), (9, "A", "hilltap Road")], "id int, c string, t string"
    )
    values = spark.createDataFrame([("A", "EXACT FIX", "Exactly")], "c string, wrong string, correct string")
    words = spark.createDataFrame([("A", "12", "twelve")], "c string, wrong string, correct string")
    entries = spark.createDataFrame([("A", "word", "Hilltop", 5), ("A", "word", "Road", 5), ("A", "word", "Casantan", 3), ("A", "word", "Davao", 9), ("A", "value", "HILLTOP ROADS", 3)], "c string, entry_type string, entry string, weight int")
    got = {r["id"]: (r["fixed"], r["fixed_by"]) for r in C.correct(df, ["c"], "t", "fixed", values=values, words=words, entries=entries).collect()}
    assert got[1] == ("CASANTAN DAVAO", "words") and got[4] == ("Exactly", "value") and got[5] == (None, "none") and got[6] == (" ", "none")
    assert got[3] == ("HILLTOP ROADS", "entry") and got[7] == ("HILLTAP", "none") and got[8] == ("Hilltop twelve", "words") and got[2] == got[9]
    assert C.correct(df.where("false"), ["c"], "t", "fixed", values=values, words=words, entries=entries).count() == 0


def test_code_format(spark):
    df = spark.createDataFrame([("2o20 0123",), ("2025/0123",), ("20200123",), ("2O200123",), ("",), (None,), ("--",), ("1-2-3",)], "v string")
    got = [r[0] for r in df.select(C.reshape_code(F.col("v"), prefix="2020", known=["2025"])).collect()]
    assert got == ["2020-0123", "2025-0123", "20200123", "20200123", "", None, "--", "1-2-3"]
    assert [r[0] for r in df.limit(1).select(C.reshape_code(F.col("v"), prefix="2020", compact=True)).collect()] == ["20200123"]


def test_city_words(spark):
    df = spark.createDataFrame([("DAVAO",), ("dauao",), ("DC",), ("MANILA",), (None,), ("DAVAOC",), ("DAUAOCTY",)], "v string")
    assert [r[0] for r in df.select(C.is_city_like(F.col("v"), "DAVAO", "DC")).collect()][:5] == [True, True, True, False, False]
    assert [r[0] for r in df.select(C.is_city_run_together(F.col("v"), "DAVAO")).collect()][3:] == [False, False, True, True]
    assert [r[0] for r in df.select(C.fix_characters(F.col("v"), {"O": "0", "D": "0"}, keep="D")).collect()][0] == "DAVA0"
