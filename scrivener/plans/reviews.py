"""Queries: review documents, evaluation listings, verdicts, session checks and patient lists."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import metrics as M
from ..operators import evaluation as E
from ..operators import ordered as W
from ..operators import stores as K
from ..sources import images, sinks, tables
from .base import CELLS, cells, query

ALNUM = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
#: Accuracy of ``b`` as a reading of ``a``, in percent.
SIM = "greatest(0.0, least(100.0, 100 * (1 - levenshtein({0}, {1})::DOUBLE / length({0}))))"


def same(c):
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def similar(a, b):
    return M.accuracy_percent(M.cer(a, b))


# ---- sources -----------------------------------------------------------------------------------------
@query("s08_one_document", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    folder = sinks.write_json(t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("run")), sinks.scratch(t.spark, "runs"), by=["run"])
    return tables.json_document(t.spark, folder, "run=F", "o_orderkey long, o_totalprice double")


@query("s18_image_tree", "SELECT DISTINCT 'side=' || n_regionkey AS category, true AS filled FROM nation")
def _(t):
    folder = sinks.write_json(t.nation.select("n_name", F.col("n_regionkey").alias("side")), sinks.scratch(t.spark, "tree"), by=["side"])
    return tables.image_tree(t.spark, folder).groupBy("category").agg((F.sum("length") > 0).alias("filled"))


@query("s14_sheet_rows", """WITH s AS (SELECT n_regionkey AS sheet, n_nationkey + 3 AS number, [n_name, n_nationkey::VARCHAR, CASE WHEN n_nationkey % 2 = 0 THEN 'x' END] AS cells FROM nation) SELECT sheet, number, cells[1] AS name, cells[2] AS code, cells[3] AS note FROM s WHERE cells[1] NOT LIKE '%A%'""")
def _(t):
    row = lambda n, *texts: F.struct(F.lit(n).alias("number"), F.array(*map(F.lit, texts)).alias("cells"))
    head = t.region.select(F.col("r_regionkey").alias("sheet"), F.inline(F.array(row(0, "Report", "7", None), row(1, "Name", "Code", "Note"))))
    blank = F.contains("n_name", F.lit("A"))
    cells_ = F.when(blank, F.array(F.lit(" "), F.lit(None), F.lit(""))).otherwise(F.array("n_name", F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "x")))
    body = t.nation.select(F.col("n_regionkey").alias("sheet"), (F.col("n_nationkey") + 3).alias("number"), cells_.alias("cells"))
    rows = tables.sheet_rows(head.unionByName(body), ["sheet"], "number", "cells")
    return rows.select("sheet", "number", *[F.col("row")[n].alias(n.lower()) for n in ("Name", "Code", "Note")])


@query("s22_statements", "SELECT o_orderkey, unnest(['UPDATE t SET a = ' || o_custkey, 'DELETE FROM u']) AS statement FROM orders")
def _(t):
    script = F.concat(F.lit("-- no; comment\nUPDATE t SET a = "), F.col("o_custkey").cast("string"), F.lit("; -- more\n;\n DELETE FROM u;\n"))
    return t.orders.select("o_orderkey", F.explode(tables.statements(script)).alias("statement"))


@query("s24_uploads", "SELECT page_id, url FROM pages WHERE regexp_matches(lower(url || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' ELSE '' END), '\\.(pdf|png|jpg)$')")
def _(t):
    name = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".exe").otherwise(""))
    return t.pages.where(tables.has_extension(name, ["pdf", "png", "jpg"])).select("page_id", "url")


@query("s19_tokens", "SELECT 'side=' || n_regionkey AS category, word, count(*) AS n FROM (SELECT n_regionkey, unnest(regexp_extract_all(n_name, '[A-Za-z0-9_]+')) AS word FROM nation) GROUP BY 1, 2")
def _(t):
    """Tokens of files by an engine; this one takes the names that are written in them."""

    def engine(content):
        return [(w, 1.0, (0, 0, 1, 1)) for line in content.decode().splitlines() for w in re.findall(r"\w+", json.loads(line)["n_name"])]

    folder = sinks.write_json(t.nation.select("n_name", F.col("n_regionkey").alias("side")), sinks.scratch(t.spark, "scans"), by=["side"])
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = images.tokens(files, engine)
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("category"), F.col("text").alias("word")).agg(F.count("*").alias("n"))


@query("s20_lines_of_words", """SELECT event_id // 20 AS page, event_id % 20 // 5 AS line, string_agg(event_type, ' ' ORDER BY event_id) AS text, avg(value % 100) / 100 AS confidence, min(event_id % 5 * 40)::DOUBLE AS x0, min(event_id % 20 // 5 * 30)::DOUBLE AS y0, max(event_id % 5 * 40 + 35)::DOUBLE AS x1, max(event_id % 20 // 5 * 30 + 20)::DOUBLE AS y1
 FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def _(t):
    e = F.col("event_id")
    line, at = F.floor(e % 20 / 5), (e % 5 * 40).cast("double")
    confidence = F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value") % 100)
    words = t.events.select(F.floor(e / 20).alias("page"), line.alias("line"), "event_id", F.concat(F.lit(" "), "event_type").alias("text"), confidence.alias("confidence"), at.alias("x0"), (line * 30).cast("double").alias("y0"), (at + 35).alias("x1"), (line * 30 + 20).cast("double").alias("y1"))
    return images.lines_of_words(words, ["page", "line"], "event_id")


@query("k22_form_lines", """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ' n/a ' ELSE c_name || ' of ' || c_mktsegment || ' at ' || o_orderpriority END AS value, greatest(1, floor(20 / 100.0 * 600 / (10 * 0.5))::INTEGER) AS most FROM orders JOIN customer ON c_custkey = o_custkey),
 l AS (SELECT o_orderkey, list_reduce(list_transform(string_split(value, ' '), lambda w: [w]), lambda a, w: CASE WHEN length(a[-1]) + 1 + length(w[1]) <= most THEN list_concat(a[:-2], [a[-1] || ' ' || w[1]]) ELSE list_concat(a, w) END) AS ls FROM f WHERE value <> ' n/a ')
 SELECT o_orderkey, (i - 1)::INTEGER AS line, ls[i] AS text, (o_orderkey % 100) / 100.0::DOUBLE * 600 AS x, 800 - 10 / 100.0::DOUBLE * 800 - (i - 1) * 12.0::DOUBLE AS y FROM l, range(1, 60) r(i) WHERE i <= len(ls)""")
def _(t):
    """Values of a form as lines of text where its boxes are; drawing them is left to a writer."""
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    value = F.when(F.col("o_orderstatus") == "P", " n/a ").otherwise(F.concat("c_name", F.lit(" of "), "c_mktsegment", F.lit(" at "), "o_orderpriority"))
    fields = joined.select("o_orderkey", value.alias("value"), (F.col("o_orderkey") % 100).cast("double").alias("x"), F.lit(10.0).alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("size"))
    return images.placed(fields, ["o_orderkey"], 600.0, 800.0)


# ---- documents and loaders ---------------------------------------------------------------------------
@query("x07_second_reading", f"WITH {CELLS} SELECT cell, coalesce(nullif(corrected, ''), truth) AS value, CASE WHEN corrected IS NULL OR confidence IS NULL OR confidence - 0.1 < 0.65 THEN 'manual_encoding_required' WHEN confidence - 0.1 < 0.85 THEN 'needs_check' ELSE 'accepted' END AS status, coalesce(corrected, '') = '' AND truth <> '' AS best_guess FROM cells")
def _(t):
    """The second engine's reading of the same cells, routed by the same thresholds, blanks filled by the best guess."""
    from ..operators.rules import route

    guess = F.coalesce("corrected", F.lit("")) == ""
    return cells(t).select("cell", F.coalesce(F.nullif("corrected", F.lit("")), "truth").alias("value"), route(F.when(F.col("corrected").isNotNull(), F.col("confidence") - 0.1)).alias("status"), (guess & (F.col("truth") != "")).alias("best_guess"))


@query("x19_row_documents", f"""WITH {CELLS}, w AS (SELECT DISTINCT page, 'Page ' || page || ': dark' AS text FROM cells WHERE page % 3 = 0),
 r AS (SELECT page // 4 AS spread, row, list(DISTINCT page) AS pages, count(*) AS n_fields FROM cells GROUP BY 1, 2), x AS (SELECT spread, row, list(text ORDER BY page) AS ws FROM r JOIN w ON list_contains(pages, page) AND page // 4 = spread GROUP BY 1, 2)
 SELECT spread, row, n_fields, coalesce(ws, []) AS warnings, ws IS NULL AS passed FROM r LEFT JOIN x USING (spread, row)""")
def _(t):
    c = cells(t).withColumn("spread", F.floor(F.col("page") / 4))
    noted = c.where("page % 3 = 0").select("spread", "page").distinct().groupBy("spread").agg(F.sort_array(F.collect_list(F.struct("page", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": dark")).alias("text")))).alias("all"))
    rows = c.groupBy("spread", "row").agg(F.collect_set("page").alias("pages"), F.count("*").alias("n_fields")).join(noted, "spread", "left")
    own = F.transform(F.filter(F.coalesce("all", F.array().cast("array<struct<page:bigint,text:string>>")), lambda x: F.array_contains("pages", x["page"])), lambda x: x["text"])
    return rows.withColumn("warnings", own).select("spread", "row", "n_fields", "warnings", (F.size("warnings") == 0).alias("passed"))


@query("x30_unified_cells", f"""WITH {CELLS}, a AS (SELECT 'workbook' AS source, cell, truth, nullif(raw, '') AS raw, CASE WHEN raw IS NOT NULL THEN length(raw) END AS accuracy FROM cells WHERE style = 'caps' AND field <> ''
 UNION ALL SELECT 'handwriting', cell, truth, nullif(corrected, ''), CASE WHEN corrected IS NOT NULL THEN 0 END FROM cells WHERE style = 'lower' AND detected) SELECT source, cell, truth, CASE WHEN raw IS NOT NULL THEN raw WHEN accuracy IS NOT NULL THEN '' END AS reading FROM a""")
def _(t):
    """A reading that came back empty is '' if it was scored, null if the engine did not run."""
    empty = F.lit("")
    book = cells(t).where("style = 'caps' and field <> ''").select(F.lit("workbook").alias("source"), "cell", "truth", F.nullif("raw", empty).alias("raw"), F.length("raw").alias("accuracy"))
    hand = cells(t).where("style = 'lower' and detected").select(F.lit("handwriting").alias("source"), "cell", "truth", F.nullif("corrected", empty).alias("raw"), F.when(F.col("corrected").isNotNull(), 0).alias("accuracy"))
    return book.unionByName(hand).select("source", "cell", "truth", F.coalesce("raw", F.when(F.col("accuracy").isNotNull(), "")).alias("reading"))


VARIANTS = ("raw", "corrected", "second", "second_corrected")
ACCURACY = "CASE WHEN {0} IS NOT NULL THEN CASE WHEN truth = '' THEN CASE WHEN {0} = '' THEN 100.0 ELSE 0.0 END ELSE greatest(0.0, least(100.0, 100 * (1 - levenshtein(truth, {0})::DOUBLE / length(truth)))) END END"


@query("x31_variant_accuracy", f"WITH {CELLS}, v AS (SELECT style, truth, raw, corrected, replace(raw, '3', 'E') AS second, replace(corrected, 'Z', '') AS second_corrected FROM cells) SELECT style, " + ", ".join(f"100.0 * count(*) FILTER ({v} = truth) / nullif(count({v}), 0) AS exact_{v}, round(avg({ACCURACY.format(v)}), 6) AS accuracy_{v}" for v in VARIANTS) + " FROM v GROUP BY 1")
def _(t):
    c = cells(t).withColumns({"second": F.replace("raw", F.lit("3"), F.lit("E")), "second_corrected": F.replace("corrected", F.lit("Z"), F.lit(""))})
    found = c.groupBy("style").agg(*E.variant_accuracy(F.col("truth"), VARIANTS))
    return found.withColumns({f"accuracy_{v}": F.round(f"accuracy_{v}", 6) for v in VARIANTS})


JUDGED = "CASE WHEN raw IS NULL OR corrected IS NULL THEN NULL WHEN raw = corrected THEN 'unchanged' WHEN corrected = truth THEN 'helpful' WHEN raw = truth THEN 'harmful' ELSE 'still_wrong' END"


@query("x32_changed_cells", f"""WITH {CELLS}, j AS (SELECT *, {JUDGED} AS outcome FROM cells WHERE truth <> '') SELECT cell, style, outcome, writer, page, row, count(*) OVER (PARTITION BY style) AS of_style,
 row_number() OVER (PARTITION BY style ORDER BY list_position(['harmful', 'still_wrong', 'helpful'], outcome), writer, page, row, cell) AS place FROM j WHERE outcome IN ('harmful', 'still_wrong', 'helpful')""")
def _(t):
    order = F.array_position(F.array(*map(F.lit, ("harmful", "still_wrong", "helpful"))), F.col("outcome"))
    judged = cells(t).where("truth <> ''").withColumn("outcome", E.judge(F.col("truth"), F.col("raw"), F.col("corrected"))).where("outcome <> 'unchanged'")
    totals = judged.groupBy("style").agg(F.count("*").alias("of_style"))
    placed = W.ranked(judged, ["style"], [order, F.col("writer"), F.col("page"), F.col("row"), F.col("cell")])
    return placed.join(totals, "style").select("cell", "style", "outcome", "writer", "page", "row", "of_style", "place")


@query("x33_cell_verdict", f"""WITH {CELLS}, a AS (SELECT *, floor({ACCURACY.format('corrected')})::BIGINT AS acc FROM cells) SELECT cell, CASE WHEN truth = '' THEN 'grey' WHEN NOT detected THEN 'red' WHEN corrected = truth THEN 'green' WHEN acc >= 80 THEN 'orange' ELSE 'red' END AS colour,
 CASE WHEN truth = '' THEN 'blank' WHEN NOT detected THEN 'row not found' WHEN corrected = truth THEN 'exact' WHEN acc >= 80 THEN 'close (' || acc || '% of characters)' ELSE 'wrong (' || coalesce(acc, 0) || '% of characters)' END AS note FROM a""")
def _(t):
    acc = F.floor(M.char_accuracy(F.col("truth"), F.col("corrected")))
    blank, lost, exact, close = F.col("truth") == "", ~F.col("detected"), F.col("corrected") == F.col("truth"), acc >= 80
    say = lambda word: F.concat(F.lit(f"{word} ("), F.coalesce(acc, F.lit(0)).cast("string"), F.lit("% of characters)"))
    colour = F.when(blank, "grey").when(lost, "red").when(exact, "green").when(close, "orange").otherwise("red")
    return cells(t).select("cell", colour.alias("colour"), F.when(blank, "blank").when(lost, "row not found").when(exact, "exact").when(close, say("close")).otherwise(say("wrong")).alias("note"))


@query("x34_cut_verdict", f"""WITH {CELLS}, o AS (SELECT a.cell, max({SIM.format('b.truth', 'a.raw')}) AS other FROM cells a JOIN cells b ON a.page = b.page AND b.row <> a.row AND b.truth <> '' AND NOT (a.truth <> '' AND {SIM.format('a.truth', 'b.truth')} >= 60) WHERE a.raw IS NOT NULL GROUP BY 1),
 s AS (SELECT cell, truth, length({ALNUM.format("coalesce(raw, '')")}) >= 2 AS read, other, CASE WHEN truth <> '' THEN {SIM.format('truth', 'raw')} END AS own FROM cells LEFT JOIN o USING (cell))
 SELECT cell, CASE WHEN truth = '' THEN CASE WHEN NOT read THEN 'blank' WHEN other >= 75 THEN 'writing in a blank' ELSE 'stray marks' END WHEN NOT read THEN 'unsure' WHEN other >= 75 AND other > own + 10 THEN 'wrong' WHEN own >= 40 AND (other IS NULL OR own >= other) THEN 'right' ELSE 'unsure' END AS verdict FROM s""")
def _(t):
    c = cells(t)
    others = c.where("truth <> ''").select("page", F.col("row").alias("o_row"), F.col("truth").alias("o_truth"))
    pairs = c.where("raw is not null").join(others, "page").where(F.col("o_row") != F.col("row"))
    apart = pairs.where((F.col("truth") == "") | (similar(F.col("truth"), F.col("o_truth")) < 60))
    best = apart.groupBy("cell").agg(F.max(similar(F.col("o_truth"), F.col("raw"))).alias("other"))
    verdict = E.cut_verdict(F.col("truth"), F.col("raw"), F.col("other"), similar(F.col("truth"), F.col("raw")), margin=10, least=40)
    return c.join(best, "cell", "left").select("cell", verdict.alias("verdict"))


@query("x35_alignment_check", f"""WITH {CELLS}, k AS (SELECT page, row, truth FROM cells WHERE truth <> ''), f AS (SELECT page, row + CASE WHEN page % 4 = 0 THEN 1 ELSE 0 END AS row, raw AS text FROM cells WHERE detected AND raw IS NOT NULL),
 s AS (SELECT coalesce(k.page, f.page) AS page, coalesce(k.row, f.row) AS row, k.truth, f.text, CASE WHEN k.truth IS NOT NULL AND f.text IS NOT NULL THEN {SIM.format('k.truth', 'f.text')} END AS here, CASE WHEN k.truth IS NOT NULL AND a.text IS NOT NULL THEN {SIM.format('k.truth', 'a.text')} END AS above, CASE WHEN k.truth IS NOT NULL AND b.text IS NOT NULL THEN {SIM.format('k.truth', 'b.text')} END AS below
  FROM k FULL JOIN f ON k.page = f.page AND k.row = f.row LEFT JOIN f a ON a.page = k.page AND a.row = k.row - 1 LEFT JOIN f b ON b.page = k.page AND b.row = k.row + 1)
 SELECT page, row, CASE WHEN truth IS NULL THEN 'found, not in key' WHEN text IS NULL THEN 'not detected' WHEN greatest(above, below) IS NULL OR here >= greatest(above, below) - 10 OR here >= 60 THEN 'aligned' ELSE 'shifted' END AS status, here, above, below FROM s""")
def _(t):
    key = cells(t).where("truth <> ''").select("page", "row", "truth")
    found = cells(t).where("detected and raw is not null").select("page", (F.col("row") + F.when(F.col("page") % 4 == 0, 1).otherwise(0)).alias("row"), F.col("raw").alias("text"))
    return E.alignment(key, found, "page", "row", similar)


@query("x36_as_read", "SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS last_name, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS admitted, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 24)::VARCHAR ELSE '' END AS hour, o_totalprice FROM orders")
def _(t):
    """The answer row with the columns that the reading fills replaced by it; a time without its date is dropped."""
    date = F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    parts = t.orders.select("o_orderkey", F.struct(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("last"), date.alias("date"), (F.col("o_orderkey") % 24).cast("string").alias("hour")).alias("p"))
    row = t.orders.select("o_orderkey", "o_totalprice", F.struct(F.lit("typed").alias("last_name"), F.lit("").alias("admitted"), F.lit("").alias("hour")).alias("q")).join(parts, "o_orderkey")
    dated = F.coalesce("p.date", F.lit("")) != ""
    q = F.col("q").withField("last_name", F.coalesce("p.last", F.lit(""))).withField("admitted", F.coalesce("p.date", F.lit(""))).withField("hour", F.when(dated, F.coalesce("p.hour", F.lit(""))).otherwise(""))
    return row.select("o_orderkey", q.alias("q"), "o_totalprice").select("o_orderkey", "q.last_name", "q.admitted", "q.hour", "o_totalprice")


@query("x37_error_flag", f"""WITH {CELLS} SELECT cell, CASE WHEN cell % 10 = 0 THEN true WHEN cell % 10 = 1 THEN false WHEN cell % 23 = 0 THEN true WHEN truth <> '' AND coalesce(raw, '') = '' THEN true ELSE {ALNUM.format('truth')} <> {ALNUM.format("coalesce(raw, '')")} END AS error FROM cells""")
def _(t):
    """A typed answer wins, a wrong box is always an error, so is a blank where something belongs; else the normalised values decide."""
    k, got = F.col("cell"), F.coalesce("raw", F.lit(""))
    typed = F.when(k % 10 == 0, "yes").when(k % 10 == 1, "no").otherwise("")
    kind = F.when(k % 23 == 0, "wrong box").otherwise("spelling")
    error = F.when(typed.isin("yes", "no"), typed == "yes").when(kind == "wrong box", True).when((F.col("truth") != "") & (got == ""), True).otherwise(same(F.col("truth")) != same(got))
    return cells(t).select("cell", error.alias("error"))


@query("x38_participants", "SELECT 'P' || (user_id % 5 + 1) AS participant, count(*) AS n FROM events GROUP BY 1")
def _(t):
    coded = t.events.select(F.concat(F.lit("P"), (F.col("user_id") % 5 + 1).cast("string")).alias("participant"))
    return tables.check_codes(coded, "participant", "P[1-5]").groupBy("participant").agg(F.count("*").alias("n"))


@query("x39_expected_outcomes", "SELECT c_custkey, CASE WHEN n_nationkey % 4 <> 0 THEN CASE WHEN n_regionkey % 2 = 0 THEN 'dark' ELSE 'normal' END ELSE 'not listed' END AS expected FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    listed = t.nation.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("string").alias("file"), F.when(F.col("n_regionkey") % 2 == 0, "dark").otherwise("normal").alias("expected"))
    path = sinks.write_csv(listed, sinks.scratch(t.spark, "expected"))
    known = tables.csv_table(t.spark, path, "file string, expected string", key="file", allowed={"expected": ("dark", "normal")})
    return t.customer.withColumn("file", F.col("c_nationkey").cast("string")).join(known, "file", "left").select("c_custkey", F.coalesce("expected", F.lit("not listed")).alias("expected"))


@query("x40_why_missed", """SELECT event_id, CASE event_type WHEN 'view' THEN 'brightness ' || floor(value)::BIGINT || ' is not below 100' WHEN 'click' THEN event_id % 100 || '% pure white (needs 60%) and darkest writing ' || floor(value)::BIGINT || ' (needs 150 or lighter)'
 WHEN 'error' THEN 'page sharpness ' || floor(value)::BIGINT || ' is not below 80' ELSE 'warned on a normal page: ' || event_type END AS why FROM events""")
def _(t):
    v, share = F.floor("value").cast("long"), F.col("event_id") % 100
    kind = F.col("event_type")
    why = F.when(kind == "view", F.format_string("brightness %d is not below 100", v)).when(kind == "click", F.format_string("%d%% pure white (needs 60%%) and darkest writing %d (needs 150 or lighter)", share, v))
    return t.events.select("event_id", why.when(kind == "error", F.format_string("page sharpness %d is not below 80", v)).otherwise(F.concat(F.lit("warned on a normal page: "), kind)).alias("why"))


DIAGNOSIS = "CASE WHEN o_orderkey % 9 = 0 THEN 'DENGUE' ELSE 'PU G' || (o_orderkey % 5 + 1) || ' P' || (o_orderkey % 4) || ' ' || (o_orderkey % 15 + 27) || ' 3/7 WKS AOG ' || CASE o_orderkey % 3 WHEN 0 THEN 'S/P LTCS' WHEN 1 THEN 'nsd' ELSE 'in labor' END END"


@query("x41_diagnosis_facts", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 5 + 1)::VARCHAR END AS gravida, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 4)::VARCHAR END AS para,
 CASE WHEN o_orderkey % 9 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'CESAREAN' WHEN 1 THEN 'VAGINAL' END END AS mode, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 15 + 27)::INTEGER END AS weeks FROM orders""")
def _(t):
    text = F.expr(DIAGNOSIS)
    return t.orders.select("o_orderkey", C.gravida_para(text).alias("g"), C.delivery_mode(text).alias("mode"), C.weeks_of_gestation(text).alias("weeks")).select("o_orderkey", "g.gravida", "g.para", "mode", "weeks")


@query("x44_names_with_enye", "SELECT c_custkey, 'DE LA ' || CASE c_custkey % 4 WHEN 0 THEN 'PEÑA' WHEN 1 THEN 'PENA' WHEN 2 THEN 'peña' ELSE NULL END || ' ' || c_name AS name FROM customer WHERE c_custkey % 4 = 0")
def _(t):
    surname = F.when(F.col("c_custkey") % 4 == 0, "PEÑA").when(F.col("c_custkey") % 4 == 1, "PENA").when(F.col("c_custkey") % 4 == 2, "peña")
    named = t.customer.select("c_custkey", F.concat_ws(" ", F.lit("DE LA"), surname, "c_name").alias("name"))
    return named.where(F.contains("name", F.lit("Ñ")))


@query("x45_family_links", """WITH c AS (SELECT o_orderkey AS claim, 'other' AS role, NULL::BIGINT AS parent FROM orders), w AS (SELECT o_orderkey AS claim, CASE WHEN o_orderkey % 11 = 0 THEN 'aunt' WHEN o_orderkey % 2 = 0 THEN 'baby' ELSE 'mother' END AS role,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey ELSE o_orderkey * 2 + 1 END END AS parent FROM orders WHERE o_orderstatus <> 'F'),
 e AS (SELECT c.*, w.claim IS NOT NULL AS asked, w.role AS wr, w.parent AS wp, CASE WHEN w.role NOT IN ('mother', 'baby', 'other') THEN 'unknown role' WHEN w.parent = c.claim THEN 'own parent' WHEN w.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c x WHERE x.claim = w.parent) THEN 'no such parent' END AS error FROM c LEFT JOIN w USING (claim))
 SELECT claim, CASE WHEN asked AND error IS NULL THEN wr ELSE role END AS role, CASE WHEN asked AND error IS NULL THEN wp ELSE parent END AS parent, error FROM e""")
def _(t):
    k = F.col("o_orderkey")
    claims = t.orders.select(k.alias("claim"), F.lit("other").alias("role"), F.lit(None).cast("long").alias("parent"))
    role = F.when(k % 11 == 0, "aunt").when(k % 2 == 0, "baby").otherwise("mother")
    wanted = t.orders.where("o_orderstatus <> 'F'").select(k.alias("claim"), role.alias("role"), F.when(k % 2 == 0, F.when(k % 8 == 0, k).otherwise(k * 2 + 1)).alias("parent"))
    return K.checked_links(claims, "claim", wanted, ("mother", "baby", "other"))


@query("x46_mother_list", "SELECT o_orderkey, o_orderstatus = 'F' AS delivered, row_number() OVER (ORDER BY o_orderstatus <> 'F', o_orderkey) AS place FROM orders WHERE o_totalprice > 100000")
def _(t):
    mothers = t.orders.where("o_totalprice > 100000").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("delivered"))
    return W.numbered(mothers, [F.desc("delivered"), F.col("o_orderkey")]).select("o_orderkey", "delivered", F.col("place").cast("long").alias("place"))


@query("x46_patient_list", "SELECT o_orderkey, saved, row_number() OVER (ORDER BY saved DESC, o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS saved FROM orders)")
def _(t):
    saved = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return W.numbered(t.orders.select("o_orderkey", saved.alias("saved")), [F.desc("saved"), F.col("o_orderkey")]).select("o_orderkey", "saved", F.col("place").cast("long").alias("place"))


@query("x47_settings", """WITH s AS (SELECT n_name AS setting, 'old' AS value FROM nation WHERE n_regionkey < 3), w AS (SELECT n_name AS setting, CASE n_nationkey % 4 WHEN 0 THEN repeat('x', 40) WHEN 1 THEN ' 12-3456789012 ' WHEN 2 THEN '12-345' ELSE NULL END AS value, n_nationkey FROM nation WHERE n_nationkey > 3),
 c AS (SELECT setting, trim(coalesce(value, '')) AS v, n_nationkey, setting IN (SELECT n_name FROM nation WHERE n_nationkey % 4 IN (1, 2)) AS numeric FROM w),
 e AS (SELECT setting, CASE WHEN numeric THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE v END AS new, CASE WHEN setting NOT IN (SELECT n_name FROM nation WHERE n_nationkey <> 7) THEN 'unknown setting' WHEN length(v) > 30 THEN 'too long' WHEN numeric AND v <> '' AND length(regexp_replace(v, '[^0-9]', '', 'g')) <> 12 THEN 'wrong number of digits' END AS error FROM c)
 SELECT setting, CASE WHEN new IS NOT NULL AND error IS NULL THEN new ELSE value END AS value, error FROM s FULL JOIN e USING (setting)""")
def _(t):
    names = {r["n_name"]: r["n_nationkey"] for r in t.nation.collect()}  # the list of settings: a fixed 25
    limits, digits = {n: 30 for n, k in names.items() if k != 7}, {n: 12 for n, k in names.items() if k % 4 in (1, 2)}
    k = F.col("n_nationkey")
    value = F.when(k % 4 == 0, F.repeat(F.lit("x"), 40)).when(k % 4 == 1, " 12-3456789012 ").when(k % 4 == 2, "12-345")
    settings = t.nation.where("n_regionkey < 3").select(F.col("n_name").alias("setting"), F.lit("old").alias("value"))
    return K.checked_settings(settings, t.nation.where("n_nationkey > 3").select(F.col("n_name").alias("setting"), value.alias("value")), limits, digits)
