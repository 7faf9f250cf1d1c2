"""Layout, numbering, checks of sources and newborn phrases on small fixtures."""

import pytest
from pyspark.sql import functions as F

from scrivener.functions import clinical, names
from scrivener.operators import layout, learning, ordered, stores
from scrivener.sources import sinks, tables


def test_document_ids_stay_in_their_folder(spark):
    for bad in ("../x", "a/b", "", "a b", "é"):
        with pytest.raises(ValueError):
            tables.json_document(spark, "/tmp", bad, "a int")


def test_codes_are_rejected_as_a_whole_and_never_shown(spark):
    df = spark.createDataFrame([("P1",), (" P5 ",), ("Maria",), (None,)], "p string")
    with pytest.raises(ValueError, match=r"2 value") as said:
        tables.check_codes(df, "p", "P[1-5]")
    assert "Maria" not in str(said.value)
    assert tables.check_codes(df.limit(2), "p", "P[1-5]").count() == 2


def test_a_cluster_needs_a_shared_folder():
    class Nowhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class getConf:  # noqa: N801
                get = staticmethod(lambda key: None)

    with pytest.raises(ValueError, match="checkpoint"):
        sinks.scratch(Nowhere, "x")


def test_numbers_over_ranges(spark):
    df = spark.createDataFrame([(x, x % 7) for x in range(500)] + [(None, 3)], "x int, k int").repartition(5)
    got = [(r["k"], r["x"]) for r in ordered.numbered(df, [F.desc("k"), F.col("x")]).orderBy("place").collect()]
    assert got == sorted([(x % 7, x) for x in range(500)] + [(3, None)], key=lambda p: (-p[0], -1 if p[1] is None else p[1]))
    assert ordered.numbered(df.where("false"), [F.col("x")]).count() == 0
    old = spark.createDataFrame([(4, "a")], "id int, name string")
    assert sorted((r["id"], r["name"]) for r in stores.appended(old, spark.createDataFrame([("c",), ("b",)], "name string"), [F.col("name")], "id").collect()) == [(4, "a"), (5, "b"), (6, "c")]


def test_newborn_phrases(spark):
    said = ["BBY GRL CRUZ", "BARY BOY SANTOS", "BADY GIRL", "BARY CRUZ", "13ABY B0Y", None, "", "ROBY BOY", "BABYGIRL CRUZ"]
    df = spark.createDataFrame([(x,) for x in said], "n string")
    assert [r[0] for r in df.select(names.newborn(F.col("n"))).collect()] == ["BABY GIRL", "BABY BOY", "BABY GIRL", None, "BABY BOY", None, None, None, "BABY GIRL"]


def test_facts_of_a_diagnosis(spark):
    df = spark.createDataFrame([("Gravida 2, Para 1 39 weeks aog via ltcs",), ("G3P2 38 2/7 WKS AOG NSVD",), ("discs",), (None,)], "d string")
    got = df.select(clinical.gravida_para(F.col("d")).alias("g"), clinical.delivery_mode(F.col("d")).alias("m"), clinical.weeks_of_gestation(F.col("d")).alias("w")).collect()
    assert [(r["g"]["gravida"], r["g"]["para"], r["m"], r["w"]) for r in got] == [("2", "1", "CESAREAN", 39), ("3", "2", "VAGINAL", 38), (None, None, None, None), (None, None, None, None)]


def test_lines_are_made_regular(spark):
    lines = [10.0, 30.0, 31.0, 50.0, 90.0, 110.0, 130.0]
    df = spark.createDataFrame([(lines,), ([],), ([5.0],)], "y array<double>").withColumn("p", layout.line_pitch(F.col("y")))
    got = df.select("p", layout.regular_lines(F.col("y"), F.col("p")).alias("r")).collect()
    assert got[0]["p"] == 20.0 and got[0]["r"] == [10.0, 30.0, 50.0, 70.0, 90.0, 110.0, 130.0]
    assert got[1]["r"] == [] and got[2]["r"] == [5.0]


def test_scripts_sheets_and_extensions(spark):
    df = spark.createDataFrame([("SELECT 1; -- x;y\n\n ;DROP t",), ("-- only",), ("",)], "s string")
    assert [r[0] for r in df.select(tables.statements(F.col("s"))).collect()] == [["SELECT 1", "DROP t"], [], []]
    files = spark.createDataFrame([("a.PDF",), ("a.b/c",), ("x.exe",), ("png",), (None,)], "f string")
    assert [r[0] for r in files.select(tables.has_extension(F.col("f"), ["pdf", "png"])).collect()] == [True, False, False, False, False]
    sheet = spark.createDataFrame([(0, ["Title", None]), (1, ["Name", "Age"]), (2, [None, " "]), (3, ["x", "5"])], "n int, c array<string>").withColumn("s", F.lit(1))
    assert [(r["n"], r["row"]) for r in tables.sheet_rows(sheet, ["s"], "n", "c").collect()] == [(3, {"Name": "x", "Age": "5"})]


def test_several_corrections_of_one_word(spark):
    df = spark.createDataFrame([("A", "teh  cat"), ("A", None), (None, "teh"), ("B", "teh")], "k string, t string")
    fixes = spark.createDataFrame([("A", "TEH", "the"), ("A", "TEH", "tea")], "k string, wrong string, correct string")
    got = learning.correct_words(df, ["k"], F.col("t"), fixes, "f").collect()
    assert sorted(((r["k"], r["f"]) for r in got), key=repr) == sorted([("A", "tea cat"), ("A", None), (None, "teh"), ("B", "teh")], key=repr)
