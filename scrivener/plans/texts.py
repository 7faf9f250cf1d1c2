"""Queries: text, date and nested-value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import metrics as M
from ..functions import names as N
from ..functions import text as X
from ..functions.similarity import clue_scores, close_match, similarity
from ..operators import learning as L
from .base import CELLS, cells, query, spread

NEAR = "n AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)"


def near(t):
    from pyspark.sql import Window

    return t.part.select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b"))


@query("f01_collapse", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.collapse(F.col("text"))).alias("h"))


@query("f02_comparable", "SELECT p_partkey, upper(trim(regexp_replace(p_name || '  ' || p_brand, '\\s+', ' ', 'g'))) AS v FROM part")
def _(t):
    return t.part.select("p_partkey", X.comparable(F.concat("p_name", F.lit("  "), "p_brand")).alias("v"))


@query("f03_alnum_key", "SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS v FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.alnum_key(F.col("c_name")).alias("v"))


@query("f04_folded_key", "SELECT c_custkey, translate(replace(trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')), ' ', ''), 'V0Q1568', 'UOOISGB') AS v FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.folded_key(F.col("c_name")).alias("v"))


@query("f05_field_normal", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN regexp_replace(upper(strftime(o_orderdate, '%m/%d.%Y')), '\\s*[-/.]\\s*', '-', 'g') WHEN 1 THEN regexp_replace(upper(o_orderpriority), '[-\\s]+', '', 'g') ELSE upper(o_orderpriority) END AS v FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 3
    kind = F.when(k == 0, "date").when(k == 1, "code").otherwise("text")
    value = F.when(k == 0, F.date_format("o_orderdate", "MM/dd.yyyy")).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", X.field_normal(kind, value).alias("v"))


@query("f06_levenshtein", f"WITH {NEAR} SELECT p_partkey, levenshtein(a, b)::INTEGER AS d FROM n")
def _(t):
    return near(t).select("p_partkey", F.levenshtein("a", "b").alias("d"))


WD = """list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))"""


@query("f07_error_rates", f"""WITH {NEAR}, v AS (SELECT *, {WD} AS voc FROM n WHERE b IS NOT NULL), e AS (SELECT *, array_to_string(list_transform(string_split(a, ' '), lambda w: chr((64 + list_position(voc, w))::INTEGER)), '') AS ca, array_to_string(list_transform(string_split(b, ' '), lambda w: chr((64 + list_position(voc, w))::INTEGER)), '') AS cb FROM v)
 SELECT p_partkey, levenshtein(a, b)::DOUBLE / length(a) AS cer, levenshtein(ca, cb)::DOUBLE / length(ca) AS wer FROM e""")
def _(t):
    return near(t).where("b is not null").select("p_partkey", M.cer(F.col("a"), F.col("b")).alias("cer"), M.wer(F.col("a"), F.col("b")).alias("wer"))


@query("f08_accuracy", f"WITH {CELLS} SELECT cell, CASE WHEN truth = '' THEN CASE WHEN raw = '' THEN 100.0::DOUBLE ELSE 0.0 END ELSE greatest(0.0, least(100.0, 100 * (1 - levenshtein(truth, raw)::DOUBLE / length(truth)))) END AS accuracy FROM cells WHERE raw IS NOT NULL")
def _(t):
    return cells(t).where("raw is not null").select("cell", M.char_accuracy(F.col("truth"), F.col("raw")).alias("accuracy"))


@query("f09_gestalt_similarity")
def _(t):
    return near(t).where("b is not null").select("p_partkey", similarity(F.col("a"), F.col("b")).alias("ratio"))


@query("f10_close_match")
def _(t):
    c = cells(t).where("raw <> ''")
    return c.select("cell", close_match(F.lower(F.substring_index("raw", " ", -1)), ["widget", "bolt", "gear", "ring", "panel", "valve", "nut", "frame"], 0.6).alias("nearest"))


@query("f11_clue_scores")
def _(t):
    return cells(t).select("cell", clue_scores(["small ring", "widget", "blu"], F.col("raw")).alias("scores"))


@query("f12_piece_similarity", f"""WITH {NEAR} SELECT p_partkey, CASE WHEN length(b) >= 8 THEN list_max(list_transform(range(1, greatest(1, length(a) - length(b) + 1) + 1), lambda i: greatest(0.0, least(100.0, 100 * (1 - levenshtein(substr(a, i, length(b)), b)::DOUBLE / least(length(a), length(b))))))) END AS best FROM n""")
def _(t):
    return near(t).select("p_partkey", M.piece_similarity(F.col("a"), F.col("b")).alias("best"))


@query("f13_word_patterns", f"""WITH {CELLS}, w AS (SELECT field, string_split(raw, ' ') AS a, string_split(corrected, ' ') AS b FROM cells WHERE raw <> '' AND corrected <> '')
 SELECT field, a AS wrong, b AS correct, count(*) AS n FROM (SELECT field, unnest(a) AS a, unnest(b) AS b FROM w WHERE len(a) = len(b)) WHERE a <> '' AND b <> '' GROUP BY 1, 2, 3""")
def _(t):
    return L.word_patterns(cells(t).where("raw <> '' and corrected <> ''"), ["field"], "raw", "corrected")


@query("f14_edge_marks", """SELECT doc_id, regexp_extract(w, '^([.,;:()]*)(.*?)([.,;:()]*)$', 1) AS before, regexp_extract(w, '^([.,;:()]*)(.*?)([.,;:()]*)$', 2) AS core, regexp_extract(w, '^([.,;:()]*)(.*?)([.,;:()]*)$', 3) AS after FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z]+[.,;:()]+', 0) AS w FROM documents) WHERE w <> ''""")
def _(t):
    w = t.documents.select("doc_id", F.regexp_extract("text", "[A-Za-z]+[.,;:()]+", 0).alias("w")).where("w <> ''")
    return w.select("doc_id", X.edges(F.col("w")).alias("e")).select("doc_id", "e.before", "e.core", "e.after")


@query("f15_words_and_gaps", "SELECT p_partkey, string_split(p_name, ' ') AS words FROM part")
def _(t):
    return t.part.select("p_partkey", X.words_and_gaps(F.col("p_name"), split_marks=True).alias("words"))


@query("f16_like_case", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) ELSE upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) END AS v FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    written = F.when(k == 0, F.upper("p_name")).when(k == 1, F.lower("p_name")).otherwise(F.initcap("p_name"))
    return t.part.select("p_partkey", X.like_case(written, F.col("p_brand")).alias("v"))


@query("f19_word_corrections", f"""WITH {CELLS}, w AS (SELECT field, cell, raw, unnest(string_split(raw, ' ')) AS x, generate_subscripts(string_split(raw, ' '), 1) AS i FROM cells WHERE raw <> '' AND raw = trim(raw) AND raw NOT LIKE '%  %')
 SELECT cell, string_agg(CASE x WHEN 'R3D' THEN 'RED' WHEN 'GR33N' THEN 'GREEN' ELSE x END, ' ' ORDER BY i) AS fixed FROM w GROUP BY 1""")
def _(t):
    c = cells(t).where("raw <> '' and raw = trim(raw) and raw not like '%  %'")
    wrong = c.select("field").distinct().select("field", F.inline(F.array(*[F.struct(F.lit(a).alias("wrong"), F.lit(b).alias("correct")) for a, b in (("R3D", "RED"), ("GR33N", "GREEN"))])))
    return L.correct_words(c, ["field"], F.col("raw"), wrong, "fixed").select("cell", "fixed")


@query("f21_split_name", """SELECT c_custkey, split_part(c_name, '#', 1) AS last, c_mktsegment AS first, CASE WHEN c_custkey % 2 = 0 THEN 'M' || c_nationkey END AS middle, CASE WHEN c_custkey % 3 = 0 THEN 'JR' END AS suffix FROM customer""")
def _(t):
    middle = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" M"), "c_nationkey")).otherwise("")
    name = F.concat(F.substring_index("c_name", "#", 1), F.when(F.col("c_custkey") % 3 == 0, " Jr.").otherwise(""), F.lit(", "), "c_mktsegment", middle)
    return spread(t.customer, "c_custkey").select("c_custkey", N.split_name(name).alias("n")).select("c_custkey", "n.last", "n.first", "n.middle", "n.suffix")


@query("f22_newborn", """SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 3) THEN 'BABY GIRL' WHEN c_custkey % 6 IN (1, 4, 5) THEN 'BABY BOY' END AS baby,
 CASE c_custkey % 6 WHEN 0 THEN 'BABY GIRL ' || c_mktsegment WHEN 1 THEN 'BABY BOY ' || c_mktsegment WHEN 2 THEN 'MARY ' || c_mktsegment WHEN 3 THEN 'DELA CRUZ, BABY GIRL ' || c_mktsegment WHEN 4 THEN 'BABY BOY REYES, ' || c_mktsegment ELSE 'REYES, BABY BOY' END AS written FROM customer""")
def _(t):
    k, rest = F.col("c_custkey") % 6, F.col("c_mktsegment")
    name = F.when(k == 0, F.concat(F.lit("8ABY GIRI "), rest)).when(k == 1, F.concat(F.lit("BB. B0Y "), rest)).when(k == 2, F.concat(F.lit("MARY "), rest))
    name = name.when(k == 3, F.concat(F.lit("DELA CRUZ , BB GRL "), rest)).when(k == 4, F.concat(F.lit("BABY BOY REYES, "), rest)).otherwise("REYES,BBYBOI")
    return t.customer.select("c_custkey", N.newborn(name).alias("baby"), N.clean_newborn(name).alias("written"))


@query("f23_restore_enye", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDIÑG ' ELSE c_mktsegment || ' ' END || c_nationkey AS v FROM customer")
def _(t):
    return t.customer.select("c_custkey", N.restore_enye(F.concat("c_mktsegment", F.lit(" "), "c_nationkey"), {"BUILDING": "BUILDIÑG"}).alias("v"))


@query("f24_clean_name", "SELECT c_custkey, trim(regexp_replace(regexp_replace(c_name, '[^A-Za-z'' -]', ' ', 'g'), '\\s+', ' ', 'g')) AS v FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.clean_name(F.col("c_name")).alias("v"))


@query("f25_capitals_by_kind", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS v FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("v"))


@query("f26_split_address", """SELECT c_custkey, 'BLK ' || c_nationkey AS lot, 'PUROK ' || (c_custkey % 9) AS sitio, c_mktsegment AS barangay, CASE WHEN c_custkey % 2 = 0 THEN 'DAVAO CITY' END AS city FROM customer""")
def _(t):
    from ..functions.places import split_address

    text = F.concat(F.lit("Blk "), "c_nationkey", F.lit(", Purok "), (F.col("c_custkey") % 9), F.lit(", "), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, ", Davao City").otherwise(""))
    parts = split_address(text, cities=["DAVAO CITY"], barangays=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return t.customer.select("c_custkey", parts.alias("a")).select("c_custkey", "a.lot", "a.sitio", "a.barangay", "a.city")


@query("f27_fix_place")
def _(t):
    return t.customer.select("c_custkey", close_match(F.replace("c_mktsegment", F.lit("E"), F.lit("F")), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], 0.8).alias("place"))


@query("f28_street_predicate", "SELECT doc_id, regexp_matches(text, '(?i)(^|\\s)(street|st\\.|road|rd\\.|avenue|ave\\.)(\\s|$)') AS has_street FROM documents")
def _(t):
    return t.documents.select("doc_id", F.col("text").rlike(r"(?i)(^|\s)(street|st\.|road|rd\.|avenue|ave\.)(\s|$)").alias("has_street"))


@query("f29_join_filled", "SELECT p_partkey, trim(CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' ELSE '' END || p_type || CASE WHEN p_size % 3 = 0 THEN ' ' || p_name ELSE '' END) AS v FROM part")
def _(t):
    return t.part.select("p_partkey", X.join_filled(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_type"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(" ")).alias("v"))


@query("f30_inference_with_reason", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(the|and)\\b') THEN 'en' WHEN regexp_matches(text, '(?i)\\b(der|und)\\b') THEN 'de' END AS guess, CASE WHEN regexp_matches(text, '(?i)\\b(the|and)\\b') THEN lower(regexp_extract(text, '(?i)\\b(the|and)\\b', 1)) WHEN regexp_matches(text, '(?i)\\b(der|und)\\b') THEN lower(regexp_extract(text, '(?i)\\b(der|und)\\b', 1)) END AS reason FROM documents WHERE regexp_matches(text, '^[ -~\\n]*$')")
def _(t):
    ascii_only = t.documents.where(F.col("text").rlike(r"^[ -~\n]*$"))
    en, de = r"(?i)\b(the|and)\b", r"(?i)\b(der|und)\b"
    said = lambda p: F.lower(F.regexp_extract("text", p, 1))
    return ascii_only.select("doc_id", F.when(F.col("text").rlike(en), "en").when(F.col("text").rlike(de), "de").alias("guess"), F.when(F.col("text").rlike(en), said(en)).when(F.col("text").rlike(de), said(de)).alias("reason"))


@query("f31_role_decision_list", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'mother' WHEN o_orderpriority = '5-LOW' THEN 'baby' WHEN o_orderdate::DATE - DATE '1996-01-01' BETWEEN 0 AND 364 THEN 'baby' WHEN o_totalprice > 300000 THEN 'mother' END AS role FROM orders")
def _(t):
    days = D.age_days(F.lit("1996-01-01").cast("date"), F.to_date("o_orderdate"))
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.when(p == "1-URGENT", "mother").when(p == "5-LOW", "baby").when(days < 365, "baby").when(F.col("o_totalprice") > 300000, "mother").alias("role"))


@query("f32_surname_match")
def _(t):
    from ..operators.linkage import surname_match

    return near(t).where("b is not null").select("p_partkey", surname_match(F.col("a"), F.col("b")).alias("same"))


OB = "'G' || (o_orderkey % 6) || 'P' || (o_orderkey % 5) || ' PU ' || (30 + o_orderkey % 12) || ' WKS ' || (o_orderkey % 7) || '/7, BABY ' || CASE WHEN o_orderkey % 2 = 0 THEN 'BOY' ELSE 'GIRL' END || ' 2.' || (o_orderkey % 10) || ' KG'"


@query("f33_text_features", f"WITH x AS (SELECT o_orderkey, {OB} AS s FROM orders) SELECT o_orderkey, regexp_extract(s, 'G\\s*(\\d+)', 1)::INTEGER AS gravida, regexp_extract(s, 'G\\s*\\d+\\s*P\\s*(\\d+)', 1)::INTEGER AS para, regexp_extract(s, '(\\d+)\\s*WKS', 1)::INTEGER AS weeks, lower(regexp_extract(s, 'BABY\\s+(BOY|GIRL)', 1)) AS sex, regexp_extract(s, '(\\d+\\.\\d+)\\s*KG', 1)::DOUBLE AS weight FROM x")
def _(t):
    from ..functions.clinical import features

    x = t.orders.select("o_orderkey", F.expr(OB.replace("WKS", "WKS")).alias("s"))
    return x.select("o_orderkey", features(F.col("s")).alias("f")).select("o_orderkey", "f.*")


@query("f34_package_decision", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring') THEN 'NCP' WHEN regexp_matches(p_name, 'bolt|gear') THEN 'MCP' WHEN p_size > 40 THEN 'ANC' ELSE 'OTHER' END AS package FROM part")
def _(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", F.when(n.rlike("ring"), "NCP").when(n.rlike("bolt|gear"), "MCP").when(F.col("p_size") > 40, "ANC").otherwise("OTHER").alias("package"))


@query("f35_fill_template", "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_name || ' by ' || p_brand END AS v FROM part")
def _(t):
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")))
    return t.part.select("p_partkey", X.fill_template(F.lit("{name} by {brand}"), values).alias("v"))


@query("f36_formatters", "SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS day, '+639' || lpad((o_orderkey % 1000000000)::VARCHAR, 9, '0') AS mobile FROM orders")
def _(t):
    mobile = F.concat(F.lit("09"), F.lpad((F.col("o_orderkey") % 1_000_000_000).cast("string"), 9, "0"))
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "MM-dd-yyyy").alias("day"), X.mobile_63(mobile).alias("mobile"))


@query("f37_strip_na", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS v FROM part")
def _(t):
    return t.part.select("p_partkey", X.strip_na(F.when(F.col("p_size") % 3 == 0, " n/A ").otherwise(F.col("p_name"))).alias("v"))


@query("f38_email_check", "SELECT doc_id, w AS address, regexp_matches(w, '^[A-Za-z0-9]([A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\\.)+[A-Za-z]{2,}$') AND NOT contains(w, '..') AS ok FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split(text, ' '), lambda x: contains(x, '@')))) AS w FROM documents)")
def _(t):
    words = F.array_distinct(F.filter(F.split("text", " "), lambda x: F.contains(x, F.lit("@"))))
    return t.documents.select("doc_id", F.explode(words).alias("address")).withColumn("ok", X.is_email(F.col("address")))


@query("f39_canonical_place", "SELECT n_nationkey, trim(regexp_replace(upper('City of ' || n_name || ' (Capital)'), '^CITY OF |\\s*\\(.*\\)$', '', 'g')) AS v FROM nation")
def _(t):
    from ..functions.places import canonical

    return t.nation.select("n_nationkey", canonical(F.concat(F.lit("City of "), "n_name", F.lit(" (Capital)"))).alias("v"))


@query("f40_number_text", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT::VARCHAR AS v FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.number_text(F.col("l_quantity")).alias("v"))


# ---- dates -------------------------------------------------------------------------------------------
@query("d01_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def _(t):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 7
    written = (
        F.when(k == 0, F.date_format(d, "MM/dd/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.translate(F.date_format(d, "MM-dd-yyyy"), "0152", "OISZ"))
        .when(k == 3, F.concat(F.date_format(d, "MM-dd-yy"), F.lit(" 10.COAM"))).when(k == 4, F.date_format(d, "MMMM d, yyyy")).when(k == 5, F.concat(F.lit("ADM "), F.date_format(d, "M.d.yyyy"))).otherwise("02-31-2020")
    )
    return t.orders.select("o_orderkey", D.parse_date(written).alias("day"))


@query("d02_plausible", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE <= DATE '1998-06-30' WHEN 1 THEN o_orderdate::DATE BETWEEN DATE '1995-06-30' AND DATE '1998-07-31' ELSE true END AS ok FROM orders")
def _(t):
    k = F.col("o_orderkey") % 3
    kind = F.when(k == 0, "birth").when(k == 1, "event").otherwise("other")
    return t.orders.select("o_orderkey", D.plausible(F.to_date("o_orderdate"), kind, F.lit("1998-06-30").cast("date")).alias("ok"))


@query("d03_year_pivot", "SELECT o_orderkey, (CASE WHEN o_orderkey % 100 >= 69 THEN 1900 ELSE 2000 END + o_orderkey % 100)::BIGINT AS y FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.full_year(F.col("o_orderkey") % 100).alias("y"))


@query("d04_parse_time", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE strftime(ts, '%H:%M') END AS clock, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%p') END AS half FROM events")
def _(t):
    k = F.col("event_id") % 3
    written = F.when(k == 0, F.date_format("ts", "MM-dd-yyyy hh;mma")).when(k == 1, F.date_format("ts", "HH:mm")).otherwise("0:00AM")
    return t.events.select("event_id", D.parse_time(written).alias("p")).select("event_id", "p.clock", "p.half")


@query("d05_ages", "SELECT o_orderkey, CASE WHEN o_orderdate::DATE >= DATE '1996-02-29' THEN o_orderdate::DATE - DATE '1996-02-29' END::INTEGER AS days, (year(o_orderdate) - 1996 - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) >= 229 THEN 0 ELSE 1 END)::INTEGER AS years FROM orders")
def _(t):
    born = F.lit("1996-02-29").cast("date")
    return t.orders.select("o_orderkey", D.age_days(born, F.to_date("o_orderdate")).alias("days"), D.age_years(born, F.to_date("o_orderdate")).alias("years"))


@query("d06_due_date", "SELECT o_orderkey, (o_orderdate::DATE + 280) AS due, ((o_orderdate::DATE - DATE '1994-12-01') // 7)::BIGINT AS weeks, ((o_orderdate::DATE - DATE '1994-12-01') % 7)::INTEGER AS days FROM orders")
def _(t):
    n = F.datediff(F.to_date("o_orderdate"), F.lit("1994-12-01").cast("date"))
    return t.orders.select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 280).alias("due"), F.floor(n / 7).alias("weeks"), (n % 7).alias("days"))


@query("d07_real_date", "SELECT o_orderkey, try_cast('2023-' || lpad((1 + o_orderkey % 12)::VARCHAR, 2, '0') || '-' || lpad((20 + o_orderkey % 12)::VARCHAR, 2, '0') AS DATE) IS NOT NULL AS ok FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.real_date(F.lit(2023), 1 + F.col("o_orderkey") % 12, 20 + F.col("o_orderkey") % 12).isNotNull().alias("ok"))


@query("d08_clock_forms", "SELECT event_id, strftime(ts, '%I:%M %p') AS h12, strftime(ts, '%H:%M') AS h24 FROM events")
def _(t):
    h24 = D.clock_24(F.date_format("ts", "hh:mm"), F.date_format("ts", "a"))
    return t.events.select("event_id", D.clock_12(F.date_format("ts", "HH:mm")).alias("h12"), h24.alias("h24"))


@query("d09_elapsed", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 5 ELSE epoch(date_trunc('second', ts))::BIGINT - epoch(TIMESTAMP '2024-01-01 00:00:00')::BIGINT END::BIGINT AS seconds FROM events")
def _(t):
    given = F.when(F.col("event_id") % 2 == 0, F.lit(5).cast("long"))
    return t.events.select("event_id", D.elapsed_seconds(given, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")).alias("seconds"))


@query("d10_trimester", "SELECT o_orderkey, CASE WHEN o_orderkey % 42 <= 12 THEN 1 WHEN o_orderkey % 42 <= 26 THEN 2 ELSE 3 END AS trimester FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.trimester(F.col("o_orderkey") % 42).alias("trimester"))


# ---- nested values -----------------------------------------------------------------------------------
@query("n01_json_fields", "SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("n02_explode_json", "SELECT user_id, (props::JSON->>'k')::INTEGER AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def _(t):
    packed = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.to_json(F.collect_list(F.from_json("props", "k int"))).alias("fields"))
    rows = packed.select("user_id", F.explode(F.from_json("fields", "array<struct<k: int>>")).alias("f"))
    return rows.groupBy("user_id", F.col("f.k").alias("k")).agg(F.count("*").alias("n"))


@query("n03_map_overlay", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'kept' ELSE p_name END AS name, p_brand AS brand FROM part")
def _(t):
    base = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    saved = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("name"), F.lit("kept"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(saved, k)), saved)
    return t.part.select("p_partkey", merged.alias("m")).select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["brand"].alias("brand"))


@query("n05_pad_array", "SELECT user_id, list_resize(list_slice(list(event_id ORDER BY event_id), 1, 4), 4, -1) AS ids FROM events GROUP BY 1")
def _(t):
    ids = t.events.groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("x"))
    return ids.select("user_id", F.slice(F.concat("x", F.array_repeat(F.lit(-1).cast("long"), 4)), 1, 4).alias("ids"))


@query("n06_lines_array", "SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS n_lines, md5(array_to_string(list_reverse(string_split(text, chr(10))), chr(10))) AS h FROM documents")
def _(t):
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(lines).alias("n_lines"), F.md5(F.array_join(F.reverse(lines), "\n")).alias("h"))


@query("n07_content_digests", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("n08_encrypt_roundtrip", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, c_custkey % 5 <> 0 AS tagged FROM customer")
def _(t):
    from ..functions.crypto import decrypt, encrypt

    key = F.lit("0123456789abcdef")
    c = t.customer.select("c_custkey", encrypt(F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")), key).alias("e"))
    again = encrypt(F.col("e"), key)
    return c.select("c_custkey", decrypt(again, key).alias("name"), F.startswith("e", F.lit("enc1:")).alias("tagged"))


@query("n10_bare_decimal", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '12.5' ELSE '7' END AS v FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.bare_decimal(F.when(F.col("o_orderkey") % 2 == 0, 12.5).otherwise(7.0).cast("decimal(6,2)")).alias("v"))
