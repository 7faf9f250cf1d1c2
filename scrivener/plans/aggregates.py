"""Queries: aggregates, summaries with totals and evaluation of readings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import evaluation as E
from ..operators import ordered as W
from .base import CELLS, cells, query

DEC = "decimal(18,2)"
dec = lambda c: F.col(c).cast(DEC)
dsum = lambda c: F.sum(dec(c)).cast("double")
davg = lambda c: F.sum(dec(c)).cast("double") / F.count(c)
LABELLED = "l AS (SELECT source, quality = 1 AS truth, toxic = 0 AS said FROM documents JOIN labels USING (doc_id))"


def labelled(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id").select("source", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("said"))


@query("a01_count_by_key", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("a02_count_and_last", "SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS shown FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("shown"))


@query("a03_supported_mode", """SELECT p_brand, p_type AS usual, n, total FROM (SELECT p_brand, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand)::BIGINT AS total, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY 1, 2)
 WHERE rn = 1 AND total >= 2 AND n::DOUBLE / total >= 0.22""")
def _(t):
    from ..operators.learning import supported_mode

    counts = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return supported_mode(counts, ["p_brand"], "p_type", "n", least=2, share=0.22).select("p_brand", F.col("p_type").alias("usual"), "n", "total")


@query("a04_weighted_vote", f"""WITH {CELLS}, r AS (SELECT page, upper(v) AS key, v AS text, c FROM (SELECT page, truth AS v, 60 AS c FROM cells UNION ALL SELECT page, raw, (confidence * 100)::INTEGER FROM cells) WHERE v <> ''),
 g AS (SELECT page, key, sum(c)::BIGINT AS score, count(*) AS votes, max(c) AS best FROM r GROUP BY 1, 2)
 SELECT page, key, votes, score FROM g QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, votes DESC, key) = 1""")
def _(t):
    from ..operators.learning import weighted_vote

    c = cells(t)
    readings = c.select("page", F.col("truth").alias("text"), F.lit(60).alias("c")).unionByName(c.select("page", F.col("raw").alias("text"), F.round(F.col("confidence") * 100).cast("int").alias("c")))
    return weighted_vote(readings, ["page"], "text", "c").select("page", "key", "votes", F.col("score").cast("long").alias("score"))


@query("a05_format_profile", """SELECT p_type, count(*) AS total, count(*) FILTER (regexp_full_match(p_brand, '[0-9A-Za-z]+')) AS compact, max_by(prefix, (n, prefix)) AS prefix FROM (SELECT p_type, p_brand, substr(p_brand, 1, 7) AS prefix, count(*) OVER (PARTITION BY p_type, substr(p_brand, 1, 7)) AS n FROM part) GROUP BY 1""")
def _(t):
    from ..operators.learning import format_profile

    return format_profile(t.part, ["p_type"], "p_brand", prefix=7)


@query("a06_min_confidence", f"WITH {CELLS} SELECT page, min(confidence) AS confidence, string_agg(raw, ' ' ORDER BY row) AS text FROM cells WHERE raw <> '' GROUP BY 1")
def _(t):
    tokens = cells(t).where("raw <> ''").groupBy("page").agg(F.sort_array(F.collect_list(F.struct("row", "raw", "confidence"))).alias("t"))
    return tokens.select("page", F.array_min(F.transform("t", lambda x: x["confidence"])).alias("confidence"), F.array_join(F.transform("t", lambda x: x["raw"]), " ").alias("text"))


@query("a07_bounds", "SELECT p_brand, min(p_size) AS x1, min(p_retailprice) AS y1, max(p_size) AS x2, max(p_retailprice) AS y2 FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.min("p_size").alias("x1"), F.min("p_retailprice").alias("y1"), F.max("p_size").alias("x2"), F.max("p_retailprice").alias("y2"))


A08 = """count(*) AS n, count(raw) AS n_read, count(*) FILTER (raw = truth) AS exact, count(DISTINCT page) AS pages, count(*) FILTER (corrected = truth AND raw <> truth) AS wins,
  count(*) FILTER (raw = truth)::DOUBLE / nullif(count(raw), 0) AS exact_share"""


@query("a08_group_summary", f"WITH {CELLS} SELECT field, {A08} FROM cells GROUP BY 1 UNION ALL SELECT 'All', {A08} FROM cells")
def _(t):
    raw, truth = F.col("raw"), F.col("truth")
    exact = F.count_if(raw == truth)
    c = cells(t)
    n = [F.count("*").alias("n"), F.count("raw").alias("n_read"), exact.alias("exact"), F.count_distinct("page").alias("pages"), F.count_if((F.col("corrected") == truth) & (raw != truth)).alias("wins"), M.ratio(exact, F.count("raw")).alias("exact_share")]
    return E.with_total(c, ["field"], n)


@query("a09_runs_aggregate", "SELECT o_custkey, count(*) AS runs, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean_price, min(o_totalprice) AS least, max(o_totalprice) AS most, count(DISTINCT o_orderpriority) AS distinct_texts, arg_min(o_orderpriority, o_orderkey) AS first_text FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(t):
    ok = t.orders.where("o_orderstatus <> 'P'")
    return ok.groupBy("o_custkey").agg(F.count("*").alias("runs"), davg("o_totalprice").alias("mean_price"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.count_distinct("o_orderpriority").alias("distinct_texts"), F.min_by("o_orderpriority", "o_orderkey").alias("first_text"))


VARIANTS = "v AS (SELECT writer, style, field, truth, 'raw' AS variant, raw AS reading FROM cells UNION ALL SELECT writer, style, field, truth, 'corrected', corrected FROM cells)"


def variants(t):
    return cells(t).unpivot(["cell", "writer", "style", "field", "page", "truth"], ["raw", "corrected"], "variant", "reading")


@query("a10_writer_summary", f"WITH {CELLS}, {VARIANTS} SELECT writer, style, variant, count(reading) AS n, count(*) FILTER (reading = truth) AS exact, sum(levenshtein(truth, reading))::BIGINT AS errors, sum(length(truth)) FILTER (reading IS NOT NULL)::BIGINT AS chars FROM v GROUP BY 1, 2, 3")
def _(t):
    return variants(t).groupBy("writer", "style", "variant").agg(F.count("reading").alias("n"), F.count_if(F.col("reading") == F.col("truth")).alias("exact"), F.sum(F.levenshtein("truth", "reading")).alias("errors"), F.sum(F.when(F.col("reading").isNotNull(), F.length("truth"))).alias("chars"))


@query("a11_style_summary", f"WITH {CELLS}, w AS (SELECT style, writer, count(*) FILTER (raw = truth)::DOUBLE / count(raw) AS score FROM cells GROUP BY 1, 2) SELECT style, median(score) AS median_score, min(score) AS least, max(score) AS most FROM w GROUP BY 1")
def _(t):
    w = cells(t).groupBy("style", "writer").agg(M.ratio(F.count_if(F.col("raw") == F.col("truth")), F.count("raw")).alias("score"))
    return w.groupBy("style").agg(F.median("score").alias("median_score"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("a12_grouping_sets", f"WITH {CELLS} SELECT coalesce(field, 'All fields') AS field, coalesce(style, 'all') AS style, count(*) AS n, count(*) FILTER (raw = truth) AS exact FROM cells GROUP BY GROUPING SETS ((field, style), (field), ())")
def _(t):
    n = [F.count("*").alias("n"), F.count_if(F.col("raw") == F.col("truth")).alias("exact")]
    c = cells(t).select("field", "style", "raw", "truth")
    sets = c.groupingSets([[F.col("field"), F.col("style")], [F.col("field")], []], F.col("field"), F.col("style")).agg(*n)
    return sets.select(F.coalesce("field", F.lit("All fields")).alias("field"), F.coalesce("style", F.lit("all")).alias("style"), "n", "exact")


@query("a13_bool_by_level", f"WITH {CELLS}, p AS (SELECT writer, page, bool_or(detected) AS seen FROM cells GROUP BY 1, 2) SELECT writer, bool_and(seen) AS all_pages, bool_or(seen) AS any_page FROM p GROUP BY 1")
def _(t):
    pages = cells(t).groupBy("writer", "page").agg(F.bool_or("detected").alias("seen"))
    return pages.groupBy("writer").agg(F.bool_and("seen").alias("all_pages"), F.bool_or("seen").alias("any_page"))


@query("a14_confidence_bands", f"WITH {CELLS} SELECT CASE WHEN confidence IS NULL THEN 'no reading' WHEN confidence < 0.65 THEN '< 0.65' WHEN confidence < 0.85 THEN '0.65 - 0.85' ELSE '>= 0.85' END AS band, count(*) AS n, count(*) FILTER (raw = truth) AS exact FROM cells GROUP BY 1")
def _(t):
    return cells(t).groupBy(E.band(F.col("confidence"), (0.65, 0.85)).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("raw") == F.col("truth")).alias("exact"))


@query("a15_threshold_sweep", f"WITH {CELLS} SELECT t::DOUBLE AS threshold, count(*) FILTER (confidence >= t) AS accepted, count(*) FILTER (confidence >= t AND raw <> truth) AS wrong, (100 * count(*) FILTER (confidence >= t AND raw <> truth))::DOUBLE / nullif(count(*) FILTER (confidence >= t), 0) AS wrong_percent FROM cells, (VALUES (0.5::DOUBLE), (0.65), (0.75), (0.85), (0.95)) v(t) GROUP BY t")
def _(t):
    return E.threshold_sweep(cells(t), (0.5, 0.65, 0.75, 0.85, 0.95), F.col("confidence"), F.col("raw") != F.col("truth"))


@query("a16_correction_metrics", f"""WITH {CELLS}, j AS (SELECT field, CASE WHEN raw IS NULL THEN NULL WHEN raw = corrected THEN 'unchanged' WHEN corrected = truth THEN 'helpful' WHEN raw = truth THEN 'harmful' ELSE 'still_wrong' END AS judged FROM cells)
 SELECT field, count(*) AS n, count(*) FILTER (judged <> 'unchanged') AS changes, count(*) FILTER (judged = 'helpful') AS helpful, count(*) FILTER (judged = 'harmful') AS harmful,
 count(*) FILTER (judged = 'helpful')::DOUBLE / nullif(count(*) FILTER (judged <> 'unchanged'), 0) AS precision, count(*) FILTER (judged = 'harmful')::DOUBLE / nullif(count(*) FILTER (judged <> 'unchanged'), 0) AS harmful_rate FROM j WHERE judged IS NOT NULL GROUP BY 1""")
def _(t):
    return E.correction_metrics(cells(t).withColumn("judged", E.judge(F.col("truth"), F.col("raw"), F.col("corrected"))), ["field"])


@query("a17_false_readings", f"WITH {CELLS} SELECT style, count(*) FILTER (truth = '') AS blank, count(*) FILTER (truth = '' AND raw <> '') AS false_readings FROM cells GROUP BY 1")
def _(t):
    blank = F.col("truth") == ""
    return cells(t).groupBy("style").agg(F.count_if(blank).alias("blank"), F.count_if(blank & (F.col("raw") != "")).alias("false_readings"))


@query("a18_set_confusion", """SELECT user_id, len(list_filter(['click', 'error'], lambda r: list_contains(f, r)))::INTEGER AS tp, len(list_filter(['click', 'error'], lambda r: NOT list_contains(f, r)))::INTEGER AS fn, len(list_filter(f, lambda r: r NOT IN ('click', 'error', 'view')))::INTEGER AS fp FROM (SELECT user_id, list(DISTINCT event_type) AS f FROM events WHERE value > 100 GROUP BY 1)""")
def _(t):
    fired = t.events.where("value > 100").groupBy("user_id").agg(F.collect_set("event_type").alias("f"))
    s = E.set_score(F.col("f"), F.array(F.lit("click"), F.lit("error")), F.array(F.lit("view")))
    return fired.select("user_id", s.alias("s")).select("user_id", *[F.size(f"s.{c}").alias(c) for c in ("tp", "fn", "fp")])


A19 = "count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn"


@query("a19_precision_recall", f"""WITH {LABELLED}, c AS (SELECT source, {A19} FROM l GROUP BY 1 UNION ALL SELECT 'All', {A19} FROM l), r AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM c)
 SELECT *, CASE WHEN precision = 0 OR recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r""")
def _(t):
    truth, said = F.col("truth"), F.col("said")
    counts = [F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn")]
    return E.prf(E.with_total(labelled(t), ["source"], counts))


@query("a20_two_by_two", f"WITH {LABELLED} SELECT count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn, count(*) FILTER (NOT truth AND NOT said) AS tn, (100 * count(*) FILTER (truth AND said))::DOUBLE / nullif(count(*) FILTER (truth), 0) AS detected, (100 * count(*) FILTER (NOT truth AND said))::DOUBLE / nullif(count(*) FILTER (NOT truth), 0) AS false_warnings FROM l")
def _(t):
    truth, said = F.col("truth"), F.col("said")
    n = labelled(t).agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
    return n.withColumn("detected", M.percent(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("false_warnings", M.percent(F.col("fp"), F.col("fp") + F.col("tn")))


@query("a21_condition_ranges", "SELECT event_type, min(value) AS low, max(value) AS high, max(value) - min(value) AS value_range, (100 * count(*) FILTER (value > 50))::DOUBLE / count(*) AS match_percent FROM events GROUP BY 1")
def _(t):
    low, high = F.min("value"), F.max("value")
    return t.events.groupBy("event_type").agg(low.alias("low"), high.alias("high"), (high - low).alias("value_range"), M.percent(F.count_if(F.col("value") > 50), F.count("*")).alias("match_percent"))


A22 = "count(*) AS cases, count(*) FILTER (l_returnflag <> 'N') AS strict, count(*) FILTER (l_returnflag <> 'N' OR l_discount > 0.05) AS lenient, sum(l_quantity::BIGINT * CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(l_quantity::BIGINT), 0) AS weighted"


@query("a22_error_reduction", f"SELECT l_linestatus, {A22} FROM lineitem GROUP BY 1 UNION ALL SELECT 'All', {A22} FROM lineitem")
def _(t):
    hit = F.col("l_returnflag") != "N"
    weight = F.col("l_quantity").cast("long")
    weighted = M.ratio(F.sum(weight * F.when(hit, 1).otherwise(0)), F.sum(weight))
    return E.with_total(t.lineitem, ["l_linestatus"], [F.count("*").alias("cases"), F.count_if(hit).alias("strict"), F.count_if(hit | (F.col("l_discount") > 0.05)).alias("lenient"), weighted.alias("weighted")])


@query("a23_median_of_medians", "WITH p AS (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, median(m) AS median_of_medians, count(*) AS participants, 100 * (max(m) - min(m)) / nullif(max(m), 0) AS spread_percent FROM p GROUP BY 1")
def _(t):
    per = t.events.groupBy("event_type", "user_id").agg(F.median("value").alias("m"))
    return per.groupBy("event_type").agg(F.median("m").alias("median_of_medians"), F.count("*").alias("participants"), F.try_divide(100 * (F.max("m") - F.min("m")), F.max("m")).alias("spread_percent"))


@query("a24_usability_score", "SELECT user_id, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN a[i] - 1 ELSE 5 - a[i] END)) * 2.5::DOUBLE AS score FROM (SELECT user_id, list(1 + event_id % 5 ORDER BY event_id)[1:10] AS a FROM events GROUP BY 1 HAVING count(*) >= 10)")
def _(t):
    first = W.top(t.events, ["user_id"], [F.col("event_id")], 10).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (1 + F.col("event_id") % 5).alias("a")))).alias("x"))
    return first.where(F.size("x") == 10).select("user_id", M.sus(F.col("x.a")).alias("score"))


@query("a25_form_accuracy", f"WITH {CELLS} SELECT field, style, count(*) AS boxes, count(*) FILTER (raw = truth) AS right_boxes, (100 * count(*) FILTER (raw = truth))::DOUBLE / count(*) AS accuracy FROM cells GROUP BY 1, 2 UNION ALL SELECT 'All', 'All', count(*), count(*) FILTER (raw = truth), (100 * count(*) FILTER (raw = truth))::DOUBLE / count(*) FROM cells")
def _(t):
    right = F.count_if(F.col("raw") == F.col("truth"))
    return E.with_total(cells(t), ["field", "style"], [F.count("*").alias("boxes"), right.alias("right_boxes"), M.percent(right, F.count("*")).alias("accuracy")])


@query("a26_stage_timing", "WITH s AS (SELECT event_type, value, value / count(*) OVER (PARTITION BY user_id) AS share FROM events) SELECT event_type, min(value) AS least, max(value) AS most, max(value) - min(value) AS value_range, min(share) AS least_share, max(share) AS most_share FROM s GROUP BY 1")
def _(t):
    s = W.share_equally(t.events, ["user_id"], F.col("value"), "share")
    return s.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), (F.max("value") - F.min("value")).alias("value_range"), F.min("share").alias("least_share"), F.max("share").alias("most_share"))


@query("a27_two_methods", f"WITH {CELLS} SELECT field, count(*) FILTER (style = 'caps' AND raw = truth) AS caps, count(*) FILTER (style = 'lower' AND raw = truth) AS lower, (count(*) FILTER (style = 'lower' AND raw = truth) - count(*) FILTER (style = 'caps' AND raw = truth)) AS difference FROM cells GROUP BY 1")
def _(t):
    return E.pivot_difference(cells(t), ["field"], "style", ("caps", "lower"), F.when(F.col("raw") == F.col("truth"), 1).otherwise(0))


@query("a28_verdict_cross_tab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'F') AS f, (100 * count(*) FILTER (o_orderstatus <> 'P'))::DOUBLE / count(*) AS decided FROM orders GROUP BY 1")
def _(t):
    n = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["O", "P", "F"]).count().na.fill(0)
    n = n.select("o_orderpriority", F.col("O").alias("o"), F.col("P").alias("p"), F.col("F").alias("f"))
    return n.withColumn("decided", M.percent(F.col("o") + F.col("f"), F.col("o") + F.col("p") + F.col("f")))


@query("a29_scalar_counts", "SELECT count(*) AS n_orders, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM orders")
def _(t):
    n = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("one")), "o_custkey", "left")
    return n.agg(F.count("*").alias("n_orders"), F.count_if(F.col("one").isNull()).alias("orphans"))


@query("a31_name_majority", "SELECT p_brand, p_type FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1")
def _(t):
    n = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return n.groupBy("p_brand").agg(F.min_by("p_type", F.struct(-F.col("n"), "p_type")).alias("p_type"))


@query("a32_majority_step", "WITH s AS (SELECT p_brand, p_size - lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS step FROM part), c AS (SELECT p_brand, step, count(*) AS n FROM s WHERE step BETWEEN 2 AND 6 GROUP BY 1, 2 HAVING count(*) >= 2) SELECT p_brand, step, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, step) = 1")
def _(t):
    step = F.col("p_size") - F.lag("p_size").over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))
    n = t.part.select("p_brand", step.alias("step")).where("step between 2 and 6").groupBy("p_brand", "step").agg(F.count("*").alias("n")).where("n >= 2")
    return n.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("m"), "step")).alias("b")).select("p_brand", "b.step", (-F.col("b.m")).alias("n"))


@query("a33_newest_per_side", "SELECT o_custkey % 2 AS side, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def _(t):
    return W.latest(t.orders.select((F.col("o_custkey") % 2).alias("side"), "o_orderkey", "o_totalprice"), ["side"], [F.col("o_orderkey")])


@query("a34_scalar_stats", "SELECT event_type, sum(value::DECIMAL(18,2))::DOUBLE / count(value) AS mean, median(value) AS median, min(value) AS low, max(value) AS high, (100 * count(*) FILTER (value < 10))::DOUBLE / nullif(count(*), 0) AS low_percent FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(davg("value").alias("mean"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"), M.percent(F.count_if(F.col("value") < 10), F.count("*")).alias("low_percent"))


@query("a35_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, min(value) AS p0, quantile_cont(value, 1.0) AS p100 FROM events GROUP BY 1")
def _(t):
    p = lambda x: F.percentile("value", F.lit(x))
    return t.events.groupBy("event_type").agg(p(0.5).alias("p50"), p(0.0).alias("p0"), p(1.0).alias("p100"))


@query("a36_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2)) AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(dec("l_extendedprice")).cast("decimal(38,2)").alias("revenue"))


@query("m01_rounding", "SELECT o_orderkey, round(o_totalprice::DECIMAL(18,2), 1)::DECIMAL(18,1) AS rounded FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(dec("o_totalprice"), 1).cast("decimal(18,1)").alias("rounded"))


@query("m02_weighted_similarity", "SELECT p_partkey, greatest(0.0, least(1.0, (3 * (1 - abs(p_size - 25)::DOUBLE / 50) + 1 * (CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END)::DOUBLE) / 4)) AS score FROM part")
def _(t):
    from ..operators.geometry import weighted_score

    parts = [(1 - F.abs(F.col("p_size") - 25).cast("double") / 50, 3), (F.when(F.col("p_type") == "ECONOMY", 1.0).otherwise(0.0), 1)]
    return t.part.select("p_partkey", weighted_score(parts).alias("score"))


@query("m06_grid_cells", "SELECT p_partkey, k.k AS row, x.x AS col, k.k * p_size AS y, x.x * 10 AS x FROM part, range(0, 3) k(k), range(0, 4) x(x)")
def _(t):
    from ..operators.geometry import grid

    return grid(t.part.select("p_partkey", "p_size"), 3, 4).select("p_partkey", "row", "col", (F.col("row") * F.col("p_size")).alias("y"), (F.col("col") * 10).alias("x"))


@query("m07_row_propagation", "SELECT p_partkey, list_transform(range(0, least(100, 1 + greatest(0, (199 - p_size)) // (p_size + 2))), lambda k: (p_size + k * (p_size + 2))::BIGINT) AS rows_at FROM part WHERE p_size > 0")
def _(t):
    from ..operators.geometry import propagate

    return t.part.where("p_size > 0").select("p_partkey", propagate(F.col("p_size").cast("long"), F.col("p_size").cast("long"), F.lit(2), F.lit(200), 100).alias("rows_at"))
