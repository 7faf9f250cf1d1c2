"""Queries: projections, routing, rules, learning, linkage and evaluation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X
from ..operators import learning as L
from ..operators import linkage as K
from ..operators import ordered as W
from ..operators import rules as R
from .base import CELLS, cells, query


# ---- projections and predicates ----------------------------------------------------------------------
@query("p01_whitelist", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    from ..sources.tables import whitelist

    return whitelist(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey", "o_orderstatus"], "orders")


@query("p02_decode_json", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (props::JSON->>'k')::INTEGER END AS k FROM events")
def _(t):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return t.events.select("event_id", F.coalesce(F.from_json(raw, "k int"), F.struct(F.lit(None).cast("int").alias("k")))["k"].alias("k"))


@query("p03_flat_map", "SELECT o_orderkey, c_name AS patient_name, o_orderpriority AS encounter_kind, o_orderstatus AS claim_status FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    from ..operators.projection import flat

    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return flat(rows, {"patient_name": "c_name", "encounter_kind": "o_orderpriority", "claim_status": "o_orderstatus"}, keep=["o_orderkey"])


@query("p04_prefill_lineage", f"WITH {CELLS} SELECT cell, coalesce(nullif(corrected, ''), nullif(raw, ''), nullif(truth, '')) AS value, CASE WHEN nullif(corrected, '') IS NOT NULL THEN 'corrected' WHEN nullif(raw, '') IS NOT NULL THEN 'raw' WHEN nullif(truth, '') IS NOT NULL THEN 'truth' END AS origin FROM cells")
def _(t):
    from ..operators.projection import first_with_origin

    return cells(t).select("cell", first_with_origin({"corrected": F.col("corrected"), "raw": F.col("raw"), "truth": F.col("truth")}).alias("v")).select("cell", "v.value", "v.origin")


@query("p05_prefill_status", f"WITH {CELLS} SELECT cell, CASE WHEN raw IS NULL OR raw = '' THEN CASE WHEN style = 'caps' THEN 'REQUIRED' ELSE 'EMPTY' END WHEN corrected <> raw THEN 'TYPED' WHEN confidence < 0.85 THEN 'NEEDS_CHECK' ELSE 'ACCEPTED' END AS status FROM cells")
def _(t):
    none = X.is_blank(F.col("raw"))
    return cells(t).select("cell", F.when(none, F.when(F.col("style") == "caps", "REQUIRED").otherwise("EMPTY")).when(F.col("corrected") != F.col("raw"), "TYPED").when(F.col("confidence") < 0.85, "NEEDS_CHECK").otherwise("ACCEPTED").alias("status"))


@query("p06_typed_values", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS day, CASE lower(o_orderstatus) WHEN 'f' THEN 'F' WHEN 'o' THEN 'O' END AS status FROM orders")
def _(t):
    from ..operators.projection import typed

    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("not a date")
    return t.orders.select("o_orderkey", typed(day, "date").alias("day"), typed(F.lower("o_orderstatus"), "enum", values=["F", "O"]).alias("status"))


@query("p07_overlay_values", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'saved' ELSE c_mktsegment END AS v FROM customer")
def _(t):
    saved = F.when(F.col("c_custkey") % 3 == 0, "saved").when(F.col("c_custkey") % 3 == 1, " ")
    return t.customer.select("c_custkey", X.first_filled(saved, F.col("c_mktsegment")).alias("v"))


@query("p08_route_confidence", f"WITH {CELLS} SELECT cell, CASE WHEN confidence IS NULL OR confidence < 0.65 THEN 'manual_encoding_required' WHEN confidence < 0.85 THEN 'needs_check' ELSE 'accepted' END AS status FROM cells")
def _(t):
    return cells(t).select("cell", R.route(F.col("confidence")).alias("status"))


@query("p09_field_status", f"WITH {CELLS} SELECT cell, CASE WHEN (coalesce(raw, '') = '') AND style <> 'caps' THEN 'empty' WHEN confidence IS NULL OR confidence < 0.65 THEN 'manual_encoding_required' WHEN confidence < 0.85 OR NOT detected THEN 'needs_check' ELSE 'accepted' END AS status FROM cells")
def _(t):
    blank = F.coalesce(F.col("raw"), F.lit("")) == ""
    return cells(t).select("cell", R.field_status(F.col("confidence"), blank, F.lit(False), ~F.col("detected"), F.col("style") == "caps").alias("status"))


@query("p10_second_look", f"WITH {CELLS} SELECT cell, raw FROM cells WHERE raw <> '' AND confidence < 0.85")
def _(t):
    return cells(t).where((F.col("raw") != "") & (R.route(F.col("confidence")) != "accepted")).select("cell", "raw")


@query("p11_capped_candidates", f"WITH {CELLS} SELECT writer, cell FROM cells WHERE confidence < 0.85 QUALIFY row_number() OVER (PARTITION BY writer ORDER BY confidence, cell) <= 20")
def _(t):
    return W.top(cells(t).where("confidence < 0.85"), ["writer"], [F.col("confidence"), F.col("cell")], 20).select("writer", "cell")


@query("p12_best_guess", f"WITH {CELLS} SELECT cell, CASE WHEN confidence < 0.65 AND raw <> '' THEN raw WHEN confidence >= 0.65 THEN corrected ELSE '' END AS value, coalesce(confidence < 0.65 AND raw <> '', false) AS best_guess FROM cells")
def _(t):
    guess = (F.col("confidence") < 0.65) & (F.col("raw") != "")
    return cells(t).select("cell", F.when(guess, F.col("raw")).when(F.col("confidence") >= 0.65, F.col("corrected")).otherwise("").alias("value"), F.coalesce(guess, F.lit(False)).alias("best_guess"))


@query("p13_drop_header_rows", f"WITH {CELLS}, r AS (SELECT page, row, count(*) FILTER (raw <> '') AS filled, count(*) FILTER (regexp_matches(raw, 'SMALL|RED')) AS heads FROM cells GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY row) AS place FROM r) SELECT page, row FROM n WHERE filled >= 1 AND NOT (place <= 3 AND heads >= 1)")
def _(t):
    from ..operators.projection import drop_header_rows

    return drop_header_rows(cells(t), ["page"], "row", "raw", "SMALL|RED", words=1, filled=1).select("page", "row")


@query("p14_saved_list", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE contains(upper(o_orderpriority), 'URG') GROUP BY 1")
def _(t):
    return t.orders.where(F.contains(F.upper("o_orderpriority"), F.lit("URG"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("p15_type_ahead", "SELECT p_brand, p_name FROM (SELECT DISTINCT p_brand, p_name FROM part WHERE contains(p_name, 'r')) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY NOT starts_with(p_name, 'r'), p_name) <= 5")
def _(t):
    hits = t.part.where(F.contains("p_name", F.lit("r"))).select("p_brand", "p_name").distinct()
    return W.top(hits, ["p_brand"], [F.desc(F.startswith("p_name", F.lit("r"))), F.col("p_name")], 5)


@query("p16_blank", f"WITH {CELLS} SELECT cell, coalesce(trim(raw), '') = '' AS blank FROM cells")
def _(t):
    return cells(t).select("cell", X.is_blank(F.col("raw")).alias("blank"))


@query("p17_first_filled", f"WITH {CELLS} SELECT cell, coalesce(nullif(trim(raw), ''), nullif(trim(truth), ''), writer) AS v FROM cells")
def _(t):
    return cells(t).select("cell", X.first_filled(F.col("raw"), F.col("truth"), F.col("writer")).alias("v"))


@query("p18_apply_review", f"WITH {CELLS}, v AS (SELECT cell, truth AS typed FROM cells WHERE style = 'caps') SELECT cell, coalesce(typed, corrected, raw) AS value, coalesce(typed <> raw, false) AS edited, typed IS NULL AND raw IS NULL AS missing FROM cells LEFT JOIN v USING (cell)")
def _(t):
    c = cells(t)
    typed = c.where("style = 'caps'").select("cell", F.col("truth").alias("typed"))
    return c.join(typed, "cell", "left").select("cell", F.coalesce("typed", "corrected", "raw").alias("value"), F.coalesce(F.col("typed") != F.col("raw"), F.lit(False)).alias("edited"), (F.col("typed").isNull() & F.col("raw").isNull()).alias("missing"))


@query("p19_source_kind", "SELECT event_id, CASE event_type WHEN 'view' THEN 'auto_ocr' WHEN 'click' THEN 'auto_config' ELSE 'manual' END AS kind FROM events")
def _(t):
    return t.events.select("event_id", X.recode(F.col("event_type"), {"view": "auto_ocr", "click": "auto_config"}, F.lit("manual")).alias("kind"))


@query("p20_target_columns", "SELECT p_type, list(p_brand ORDER BY p_brand) AS targets FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY 1")
def _(t):
    return t.part.groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("targets"))


@query("p21_ditto", "SELECT p_partkey, p_size % 4 <= 1 AS ditto FROM part")
def _(t):
    k = F.col("p_size") % 4
    return t.part.select("p_partkey", X.is_ditto(F.when(k == 0, "-do-").when(k == 1, '"').when(k == 2, "").otherwise(F.col("p_name"))).alias("ditto"))


@query("p22_page_sides", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'left' ELSE 'right' END AS side, 'SP-' || lpad(((o_orderkey + 1) // 2 % 100)::VARCHAR, 2, '0') AS spread FROM orders")
def _(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.when(k % 2 == 1, "left").otherwise("right").alias("side"), F.format_string("SP-%02d", F.floor((k + 1) / 2) % 100).alias("spread"))


@query("p23_header_category", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'RING' WHEN contains(p_name, 'bolt') THEN 'BOLT' END AS category FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(F.contains("p_name", F.lit("ring")), "RING").when(F.contains("p_name", F.lit("bolt")), "BOLT").alias("category"))


@query("p24_exclusion_reasons", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 'held order' WHEN c_name IN (SELECT c_name FROM customer WHERE c_acctbal < 0) THEN 'held value' END AS reason FROM customer")
def _(t):
    held = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("h", F.lit(True))
    negative = t.customer.where("c_acctbal < 0").select("c_name").distinct().withColumn("v", F.lit(True))
    both = t.customer.join(held, "c_custkey", "left").join(negative, "c_name", "left")
    return both.select("c_custkey", F.when(F.col("h"), "held order").when(F.col("v"), "held value").alias("reason"))


# ---- rules -------------------------------------------------------------------------------------------
def order_rules():
    return [
        R.Rule("price_low", "value", R.WARN, F.col("o_totalprice") < 5000, "small total"),
        R.Rule("late", "date", R.BLOCK, F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"), "after the period", ("cf1",)),
        R.Rule("urgent_open", "status", R.BLOCK, (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), "urgent and open"),
        R.Rule("risky", "risk", R.RISK, F.col("o_totalprice") > 400000, "large total"),
    ]


FIRED = "list_filter([CASE WHEN o_totalprice < 5000 THEN 'price_low' END, CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' THEN 'late' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'urgent_open' END, CASE WHEN o_totalprice > 400000 THEN 'risky' END], lambda x: x IS NOT NULL)"


@query("r01_features", "SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity::BIGINT)::BIGINT AS quantity, bool_or(l_returnflag = 'R') AS any_returned, max(l_shipdate)::DATE - min(l_shipdate)::DATE AS span_days FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.datediff(F.to_date(F.max("l_shipdate")), F.to_date(F.min("l_shipdate"))).cast("long").alias("span_days"))


@query("r02_rule_list", f"SELECT rule, count(*) AS n FROM (SELECT unnest({FIRED}) AS rule FROM orders) GROUP BY 1")
def _(t):
    return t.orders.select(F.explode(R.fired(order_rules())).alias("x")).groupBy(F.col("x.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("r03_rule_run", f"SELECT o_orderkey, (len(list_filter(f, lambda x: x IN ('late', 'urgent_open'))))::INTEGER AS n_critical, (len(list_filter(f, lambda x: x = 'price_low')))::INTEGER AS n_warning, len(list_filter(f, lambda x: x IN ('late', 'urgent_open'))) = 0 AS can_generate FROM (SELECT o_orderkey, {FIRED} AS f FROM orders)")
def _(t):
    return R.run_rules(t.orders, order_rules(), "cf1").select("o_orderkey", "n_critical", "n_warning", "can_generate")


@query("r04_critical_subset", f"SELECT o_orderkey, list_filter({FIRED}, lambda x: x = 'urgent_open') AS rules FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(t):
    critical = [r for r in order_rules() if r.severity == R.BLOCK and not r.scopes]
    return t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.transform(R.fired(critical), lambda x: x["rule"]).alias("rules"))


@query("r05_required_fields", f"WITH {CELLS} SELECT cell, list_filter([CASE WHEN coalesce(trim(raw), '') = '' THEN 'raw_missing' END, CASE WHEN coalesce(trim(truth), '') = '' THEN 'truth_missing' END], lambda x: x IS NOT NULL) AS missing FROM cells")
def _(t):
    return cells(t).select("cell", F.transform(R.fired(R.required(["raw", "truth"])), lambda x: x["rule"]).alias("missing"))


@query("r06_cross_record", "SELECT a.o_orderkey, list_filter([CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'priority' END, CASE WHEN a.o_totalprice > b.o_totalprice THEN 'price' END], lambda x: x IS NOT NULL) AS differs FROM orders a JOIN (SELECT o_custkey, min(o_orderkey) AS first_key, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.first_key")
def _(t):
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("fk"), F.min_by("o_orderpriority", "o_orderkey").alias("fp"), F.min_by("o_totalprice", "o_orderkey").alias("ft"))
    joined = t.orders.join(first, "o_custkey").where("o_orderkey <> fk")
    rules = [R.Rule("priority", "x", R.BLOCK, F.col("o_orderpriority") != F.col("fp")), R.Rule("price", "x", R.WARN, F.col("o_totalprice") > F.col("ft"))]
    return joined.select("o_orderkey", F.transform(R.fired(rules), lambda x: x["rule"]).alias("differs"))


@query("r07_problems_and_warnings", "SELECT l_orderkey, count(*) FILTER (l_quantity > 49) AS problems, count(*) FILTER (l_discount > 0.09) AS warnings FROM lineitem GROUP BY 1")
def _(t):
    rules = [R.Rule("much", "x", R.BLOCK, F.col("l_quantity") > 49), R.Rule("cheap", "x", R.WARN, F.col("l_discount") > 0.09)]
    run = R.run_rules(t.lineitem, rules)
    return run.groupBy("l_orderkey").agg(F.sum("n_critical").alias("problems"), F.sum("n_warning").alias("warnings"))


@query("r08_copy_values", "SELECT o_orderkey, k AS field, v AS value FROM (SELECT o_orderkey, unnest(['name', 'segment']) AS k, unnest([c_name, c_mktsegment]) AS v FROM orders JOIN customer ON o_custkey = c_custkey) WHERE v IS NOT NULL")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = F.array(F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")))
    return joined.select("o_orderkey", F.inline(rows)).where("value is not null")


@query("r09_derived_fields", "SELECT o_orderkey, o_orderdate::DATE + 30 AS due, o_orderdate::DATE + 40 AS closing, (o_orderdate::DATE + 40) - o_orderdate::DATE AS days FROM orders")
def _(t):
    d = t.orders.withColumn("due", F.date_add(F.to_date("o_orderdate"), 30)).withColumn("closing", F.date_add("due", 10))
    return d.select("o_orderkey", "due", "closing", F.datediff("closing", F.to_date("o_orderdate")).cast("long").alias("days"))


@query("r10_forms_by_package", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN ['cf1', 'csf'] WHEN 'SMALL' THEN ['cf1', 'cf2', 'cf4'] ELSE ['cf1', 'cf2'] END AS forms FROM part")
def _(t):
    forms = lambda *x: F.array(*map(F.lit, x))
    return t.part.select("p_partkey", F.when(F.col("p_type") == "ECONOMY", forms("cf1", "csf")).when(F.col("p_type") == "SMALL", forms("cf1", "cf2", "cf4")).otherwise(forms("cf1", "cf2")).alias("forms"))


#: Attempts to sign in: errors and clicks are wrong, sign-ups right, a few accounts share them; in DuckDB SQL and below in Spark.
ATTEMPTS = """att AS (SELECT 'A' || (user_id % 4) AS account, event_id AS attempt, epoch_us(ts) AS us, event_type = 'signup' AS ok FROM events WHERE event_type IN ('error', 'click', 'signup')),
 r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY us, attempt) AS i FROM att),
 walk AS (SELECT account, i, attempt, NULL::VARCHAR AS outcome, 0::BIGINT AS wrong, 0::BIGINT AS locks, 0::BIGINT AS until, 0::BIGINT AS seen, 0::BIGINT AS lock_seconds FROM (SELECT account, 0::BIGINT AS i, NULL::BIGINT AS attempt FROM r GROUP BY account)
  UNION ALL SELECT account, i, attempt, CASE WHEN us < until THEN 'refused' WHEN ok THEN 'right' WHEN w + 1 < 5 THEN 'wrong' ELSE 'locked' END, CASE WHEN us < until THEN w WHEN ok OR w + 1 >= 5 THEN 0 ELSE w + 1 END,
   CASE WHEN us < until THEN k WHEN ok THEN 0 WHEN w + 1 >= 5 THEN k + 1 ELSE k END, CASE WHEN us < until THEN until WHEN ok THEN 0 WHEN w + 1 >= 5 THEN us + [60, 300, 600][least(k, 2) + 1] * 1000000 ELSE until END,
   CASE WHEN us < until THEN seen WHEN ok THEN 0 ELSE us END, CASE WHEN us < until THEN (until - us) // 1000000 + 1 WHEN NOT ok AND w + 1 >= 5 THEN [60, 300, 600][least(k, 2) + 1] ELSE 0 END
  FROM (SELECT r.*, walk.until, walk.seen, CASE WHEN r.us - seen > 3600000000 AND r.us >= until THEN 0 ELSE wrong END AS w, CASE WHEN r.us - seen > 3600000000 AND r.us >= until THEN 0 ELSE locks END AS k FROM walk JOIN r ON r.account = walk.account AND r.i = walk.i + 1))
 SELECT lower(account) AS account, attempt, outcome, CASE WHEN outcome IN ('refused', 'locked') THEN 0 ELSE 5 - wrong END::INTEGER AS attempts_left, lock_seconds FROM walk WHERE i > 0"""


def attempts(events):
    return events.where(F.col("event_type").isin("error", "click", "signup")).withColumn("account", F.concat(F.lit("A"), (F.col("user_id") % 4).cast("string")))


@query("r11_lock_ladder", f"WITH RECURSIVE {ATTEMPTS}")
def _(t):
    from ..operators.ladder import lock_ladder

    return lock_ladder(attempts(t.events), "account", "event_id", "ts", F.col("event_type") == "signup").drop("at")


@query("st4_lock_ladder", f"WITH RECURSIVE {ATTEMPTS}")
def _(t):
    from ..operators.ladder import lock_ladder_stream
    from ..streaming import windows

    windows.with_rocksdb(t.spark)
    stream = windows.closed(attempts(windows.event_stream(t.spark, t.folder, "events")))
    return windows.drain(lock_ladder_stream(stream, "account", "event_id", "ts", F.col("event_type") == "signup"), "ladder", "append").drop("at")


@query("r12_suggestion")
def _(t):
    from ..functions.similarity import clue_scores

    patterns = {"ring work": ["small ring", "red ring"], "bolts": ["blue bolt"], "widgets": ["widget"]}
    clues = [(name, c) for name, cs in patterns.items() for c in cs]
    scored = cells(t).where("raw <> ''").select("cell", F.posexplode(clue_scores([c for _, c in clues], F.col("raw"))).alias("i", "score"))
    named = scored.withColumn("pattern", F.element_at(F.array(*[F.lit(n) for n, _ in clues]), F.col("i") + 1)).groupBy("cell", "pattern").agg(F.max("score").alias("score"))
    return W.ranked(named, ["cell"], [F.desc("score"), F.col("pattern")]).where("(place = 1 and score >= 0.7) or (place between 2 and 4 and score >= 0.5)")


@query("r13_outcomes", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'Prevented' WHEN o_orderstatus = 'F' THEN 'Blocked' WHEN o_orderstatus = 'P' THEN 'Warned' ELSE 'Gets through' END AS outcome FROM orders")
def _(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") < 1000, "Prevented").when(s == "F", "Blocked").when(s == "P", "Warned").otherwise("Gets through").alias("outcome"))


@query("r14_box_check", f"WITH {CELLS} SELECT cell, CASE WHEN style = 'caps' THEN raw = truth ELSE upper(trim(raw)) = upper(trim(truth)) END AS ok FROM cells")
def _(t):
    return cells(t).select("cell", R.box_check(F.when(F.col("style") == "caps", "exact").otherwise("text"), F.col("truth"), F.col("raw")).alias("ok"))


@query("r15_error_attribution", f"WITH {CELLS} SELECT CASE WHEN raw IS NULL THEN 'not read' WHEN corrected = truth THEN 'right' WHEN raw = truth THEN 'correction' ELSE 'reading' END AS cause, count(*) AS n FROM cells GROUP BY 1")
def _(t):
    cause = F.when(F.col("raw").isNull(), "not read").when(F.col("corrected") == F.col("truth"), "right").when(F.col("raw") == F.col("truth"), "correction").otherwise("reading")
    return cells(t).groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


# ---- linkage -----------------------------------------------------------------------------------------
@query("j06_linkage_score", """SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key, CASE WHEN a.o_orderdate = b.o_orderdate THEN 3 WHEN a.o_orderdate::DATE - b.o_orderdate::DATE BETWEEN 0 AND 3 THEN 1 ELSE 0 END + CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 2 ELSE 0 END AS score
 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'O' AND b.o_orderstatus = 'F' WHERE CASE WHEN a.o_orderdate = b.o_orderdate THEN 3 WHEN a.o_orderdate::DATE - b.o_orderdate::DATE BETWEEN 0 AND 3 THEN 1 ELSE 0 END + CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 2 ELSE 0 END > 0""")
def _(t):
    side = lambda s, p: t.orders.where(f"o_orderstatus = '{s}'").select(F.col("o_orderkey").alias(f"{p}_key"), F.col("o_custkey").alias(f"{p}_cust"), F.to_date("o_orderdate").alias(f"{p}_day"), F.col("o_orderpriority").alias(f"{p}_prio"))
    points = [("a_day = b_day", 3), ("datediff(a_day, b_day) between 1 and 3", 1), ("a_prio = b_prio", 2)]
    return K.scored_links(side("O", "a"), side("F", "b"), "a_key", "b_key", [(F.col("a_cust"), F.col("b_cust"))], points).select("a_key", "b_key", "score")


@query("j08_nearest_entry")
def _(t):
    entries = t.part.groupBy("p_type", F.upper("p_name").alias("entry")).agg(F.count("*").alias("weight")).withColumnRenamed("p_type", "field")
    return K.near_entry(cells(t).where("raw <> ''").select("cell", "field", "raw"), entries, ["field"], "raw", "entry", "weight", 0.85).select("cell", "nearest", "nearest_score")


@query("j09_pattern_ranking")
def _(t):
    from ..functions.similarity import clue_scores

    scored = cells(t).where("raw <> ''").select("cell", F.posexplode(clue_scores(["small ring", "red widget", "blue bolt"], F.col("raw"))).alias("pattern", "score"))
    return W.ranked(scored, ["cell"], [F.desc("score"), F.col("pattern")]).where("place <= 2")


@query("j17_fuzzy_semi_join")
def _(t):
    held = t.part.groupBy(F.col("p_type").alias("field"), F.upper("p_name").alias("entry")).agg(F.count("*").alias("weight"))
    c = cells(t).where("raw <> ''").select("cell", "field", "raw")
    exact = c.join(held.select("field", F.col("entry").alias("raw")), ["field", "raw"], "left_semi").select("cell")
    near = K.near_entry(c, held, ["field"], "raw", "entry", "weight", 0.85).where("nearest is not null").select("cell")
    return exact.union(near).distinct()


# ---- further evaluation operators ----------------------------------------------------------------------
@query("x01_reading_score", f"WITH {CELLS} SELECT cell, raw = truth AS exact, CASE WHEN truth = '' THEN CASE WHEN raw = '' THEN 100.0::DOUBLE ELSE 0.0 END ELSE greatest(0.0, least(100.0, 100 * (1 - levenshtein(truth, raw)::DOUBLE / length(truth)))) END AS accuracy, len(list_filter(string_split(truth, ' '), lambda w: list_contains(string_split(raw, ' '), w)))::INTEGER AS mapped_right FROM cells WHERE raw IS NOT NULL")
def _(t):
    hit = F.filter(F.split("truth", " "), lambda w: F.array_contains(F.split("raw", " "), w))
    return cells(t).where("raw is not null").select("cell", (F.col("raw") == F.col("truth")).alias("exact"), M.char_accuracy(F.col("truth"), F.col("raw")).alias("accuracy"), F.size(hit).alias("mapped_right"))


@query("x02_mapped_fields", "SELECT o_orderkey, kv[1] AS field, kv[2] AS value FROM (SELECT o_orderkey, unnest([['orders.status', o_orderstatus], ['orders.priority', o_orderpriority]]) AS kv FROM orders)")
def _(t):
    m = F.create_map(F.lit("orders.status"), F.col("o_orderstatus"), F.lit("orders.priority"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", F.explode(m).alias("field", "value"))


@query("x03_best_engine", f"WITH {CELLS} SELECT cell, CASE WHEN raw IS NULL THEN 'none' WHEN levenshtein(truth, raw) < levenshtein(truth, corrected) THEN 'raw' WHEN levenshtein(truth, raw) > levenshtein(truth, corrected) THEN 'corrected' ELSE 'Tie' END AS best FROM cells")
def _(t):
    a, b = F.levenshtein("truth", "raw"), F.levenshtein("truth", "corrected")
    return cells(t).select("cell", F.when(F.col("raw").isNull(), "none").when(a < b, "raw").when(a > b, "corrected").otherwise("Tie").alias("best"))


@query("x04_score_variants", f"WITH {CELLS} SELECT cell, 'raw' AS variant, raw = truth AS exact FROM cells WHERE raw IS NOT NULL UNION ALL SELECT cell, 'corrected', corrected = truth FROM cells WHERE corrected IS NOT NULL")
def _(t):
    long = cells(t).unpivot(["cell", "truth"], ["raw", "corrected"], "variant", "reading").where("reading is not null")
    return long.select("cell", "variant", (F.col("reading") == F.col("truth")).alias("exact"))


@query("x05_correction_chain", f"WITH {CELLS} SELECT cell, upper(trim(replace(raw, '3', 'E'))) AS v FROM cells")
def _(t):
    return cells(t).select("cell", X.comparable(F.replace("raw", F.lit("3"), F.lit("E"))).alias("v"))


@query("x06_attach_truth", f"WITH {CELLS}, k AS (SELECT page, row, truth FROM cells WHERE detected) SELECT c.cell, coalesce(k.truth, '') AS truth, c.raw FROM cells c LEFT JOIN k ON c.page = k.page AND c.row = k.row")
def _(t):
    c = cells(t)
    keys = c.where("detected").select("page", "row", F.col("truth").alias("key_truth"))
    return c.join(keys, ["page", "row"], "left").select("cell", F.coalesce("key_truth", F.lit("")).alias("truth"), "raw")


@query("x08_entry_candidates", """SELECT p_type, entry_type, upper(shown) AS entry_key, count(*) AS n FROM (SELECT p_type, 'value' AS entry_type, p_name AS shown FROM part UNION ALL SELECT p_type, 'word', unnest(list_filter(string_split(p_name, ' '), lambda w: regexp_full_match(w, '[a-z]{3,}'))) FROM part) GROUP BY 1, 2, 3""")
def _(t):
    return L.entries(t.part, ["p_type"], "p_name").select("p_type", "entry_type", "entry_key", "n")


@query("x09_entries_two_sources", "SELECT k, sum(n)::BIGINT AS n FROM (SELECT upper(p_brand) AS k, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT upper(c_mktsegment), count(*) FROM customer GROUP BY 1) GROUP BY 1")
def _(t):
    from ..operators.stores import counting_upsert

    a = t.part.groupBy(F.upper("p_brand").alias("k")).agg(F.count("*").alias("n"))
    return counting_upsert(a, t.customer.groupBy(F.upper("c_mktsegment").alias("k")).agg(F.count("*").alias("n")), ["k"], ["n"])


@query("x10_model_precedence", "SELECT n_nationkey, CASE WHEN n.c IS NOT NULL THEN 'learned' WHEN s.c IS NOT NULL THEN 'reviewed' ELSE 'starter' END AS origin FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9500 GROUP BY 1) n ON n.c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) s ON s.s_nationkey = n_nationkey")
def _(t):
    learned = t.customer.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"), F.lit("learned").alias("l")).distinct()
    reviewed = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.lit("reviewed").alias("r")).distinct()
    return t.nation.join(learned, "n_nationkey", "left").join(reviewed, "n_nationkey", "left").select("n_nationkey", F.coalesce("l", "r", F.lit("starter")).alias("origin"))


@query("x11_sure_readings", f"WITH {CELLS} SELECT cell, raw = corrected AND confidence >= 0.65 AND regexp_full_match(raw, '[A-Z ]+') AS sure FROM cells WHERE raw <> ''")
def _(t):
    return cells(t).where("raw <> ''").select("cell", ((F.col("raw") == F.col("corrected")) & (F.col("confidence") >= 0.65) & F.col("raw").rlike("^[A-Z ]+$")).alias("sure"))


@query("x12_apply_reading", f"WITH {CELLS} SELECT cell, corrected AS value, CASE WHEN confidence >= 0.65 THEN 'needs_check' ELSE 'manual_encoding_required' END AS status FROM cells WHERE raw <> '' AND confidence < 0.85")
def _(t):
    status = R.route(F.col("confidence"))
    return cells(t).where((F.col("raw") != "") & (status != "accepted")).select("cell", F.col("corrected").alias("value"), status.alias("status"))


@query("x13_best_clue")
def _(t):
    from ..functions.similarity import clue_scores

    clues = ["SMALL RING", "RED", "LARGE WIDGET"]
    s = clue_scores(clues, F.col("raw"))
    bonus = F.zip_with(s, F.array(*[F.lit(0.001 * max(0, 30 - len(c.replace(" ", "")))) for c in clues]), lambda a, b: a - b)
    return cells(t).where("raw <> ''").select("cell", F.greatest(F.lit(0.0), F.array_max(bonus)).alias("score"))


@query("x14_structured_parts", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS number FROM orders")
def _(t):
    code = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    return t.orders.select("o_orderkey", F.split_part(code, F.lit("-"), F.lit(1)).cast("int").alias("y"), F.split_part(code, F.lit("-"), F.lit(2)).alias("number"))


@query("x15_canonical_parts", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE year(o_orderdate) || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') END AS code FROM orders")
def _(t):
    number = F.when(F.col("o_orderkey") % 10 != 0, F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    return t.orders.select("o_orderkey", F.when(number.isNull(), "").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), number)).alias("code"))


@query("x16_parts_to_columns", "SELECT o_orderkey, unnest(['claims.status', 'claims.kind']) AS target, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders")
def _(t):
    return t.orders.unpivot(["o_orderkey"], [F.col("o_orderstatus").alias("claims.status"), F.col("o_orderpriority").alias("claims.kind")], "target", "value")


@query("x17_draft_records", "SELECT o_orderkey, split_part(c_name, '#', 1) AS last_name, o_orderdate::DATE AS admitted, list_filter([CASE WHEN o_totalprice > 300000 THEN 'check total' END, CASE WHEN c_acctbal < 0 THEN 'check balance' END], lambda x: x IS NOT NULL) AS warnings FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rules = [R.Rule("check total", "x", R.WARN, F.col("o_totalprice") > 300000), R.Rule("check balance", "x", R.WARN, F.col("c_acctbal") < 0)]
    return joined.select("o_orderkey", F.substring_index("c_name", "#", 1).alias("last_name"), F.to_date("o_orderdate").alias("admitted"), F.transform(R.fired(rules), lambda x: x["rule"]).alias("warnings"))


@query("x18_fields_to_map", f"WITH {CELLS} SELECT page, count(*) FILTER (raw <> '') AS n_values, string_agg(row || '=' || raw, ';' ORDER BY row) FILTER (raw <> '') AS packed FROM cells GROUP BY 1 HAVING count(*) FILTER (raw <> '') > 0")
def _(t):
    m = cells(t).where("raw <> ''").groupBy("page").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("row", "raw")))).alias("m"))
    return m.select("page", F.size("m").cast("long").alias("n_values"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ";").alias("packed"))


# ---- the correction cascade ------------------------------------------------------------------------------
@query("f17_code_format", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2o20 ' || n ELSE y || '/' || n END AS code, CASE WHEN o_orderkey % 3 = 0 THEN '2020-' || n ELSE y || '-' || n END AS shaped FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS n FROM orders)")
def _(t):
    from ..operators.correction import reshape_code

    y, n = F.date_format("o_orderdate", "yyyy"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
    code = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("2o20 "), n)).otherwise(F.concat(y, F.lit("/"), n))
    known = [str(x) for x in range(1995, 2002)]
    return t.orders.select("o_orderkey", code.alias("code"), reshape_code(code, prefix="2020", known=known).alias("shaped"))


def vocabulary(t):
    words = L.entries(t.part, ["p_type"], "p_name").where("entry_type = 'word'")
    return words.select(F.col("p_type").alias("field"), "entry_type", F.col("entry_key").alias("entry"), F.col("n").alias("weight"))


@query("f18_split_run_together", """SELECT DISTINCT p_type AS field, upper(replace(p_name, ' ', '')) AS word, upper(split_part(p_name, ' ', 1)) AS "left", upper(split_part(p_name, ' ', 2)) AS "right" FROM part WHERE length(split_part(p_name, ' ', 1)) >= 4 AND length(split_part(p_name, ' ', 2)) >= 4""")
def _(t):
    from ..operators.correction import split_run_together

    names = F.split("p_name", " ")
    joined = t.part.where((F.length(names[0]) >= 4) & (F.length(names[1]) >= 4)).select(F.col("p_type").alias("field"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("word"))
    return split_run_together(joined, vocabulary(t), ["field"], "word")


@query("f19_cascade")
def _(t):
    from ..operators.correction import correct

    c = cells(t).select("cell", "field", "style", "raw", "truth")
    learned = c.where("style = 'caps' and raw <> '' and truth <> ''")
    whole = learned.groupBy("field", F.upper("raw").alias("wrong"), F.col("truth").alias("correct")).agg(F.count("*").alias("n"))
    support = lambda counts: L.supported_mode(counts, ["field", "wrong"], "correct").where("correct <> wrong")
    words = L.word_patterns(learned, ["field"], "raw", "truth")
    return correct(c.drop("style"), ["field"], "raw", "fixed", values=support(whole), words=support(words), entries=vocabulary(t)).select("cell", "fixed", "fixed_by")


@query("f20_city_words")
def _(t):
    from ..operators.correction import is_city_like, is_city_run_together

    w = F.upper(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", is_city_like(F.replace(w, F.lit("I"), F.lit("1")), "BUILDING", "BD").alias("like"), is_city_run_together(F.concat(w, F.lit("CTY")), "BUILDING").alias("together"))
