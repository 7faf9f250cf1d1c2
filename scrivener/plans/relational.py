"""Queries: scans, joins, order, windows, sets and keyed stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered as W
from ..operators import stores as K
from .base import query

DEC = "decimal(18,2)"
MONTH1 = "ts < TIMESTAMP '2024-01-16 00:00:00'"


# ---- scans -------------------------------------------------------------------------------------------
@query("s01_active_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    return t.orders.where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_custkey")


@query("s02_point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def _(t):
    return t.customer.where(F.col("c_custkey") == 42).select("c_custkey", "c_name", "c_acctbal")


@query("s03_secondary_scan", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 40")
def _(t):
    return t.orders.where(F.col("o_custkey").between(10, 40)).select("o_custkey", "o_orderkey", "o_totalprice").orderBy("o_custkey", "o_orderkey")


@query("s04_existence_probe", "SELECT exists(SELECT 1 FROM events WHERE event_type = 'error') AS has_errors, exists(SELECT 1 FROM events WHERE event_type = 'refund') AS has_refunds FROM region WHERE r_regionkey = 0")
def _(t):
    probe = lambda kind, name: t.events.agg(F.coalesce(F.bool_or(F.col("event_type") == kind), F.lit(False)).alias(name))
    return probe("error", "has_errors").crossJoin(F.broadcast(probe("refund", "has_refunds")))  # one row each


@query("s05_catalog_scan", "SELECT 'c_name' AS column_name, max(length(c_name)) AS longest, count(*) FILTER (c_name IS NULL) AS n_null FROM customer UNION ALL SELECT 'c_mktsegment', max(length(c_mktsegment)), count(*) FILTER (c_mktsegment IS NULL) FROM customer")
def _(t):
    from ..sources.tables import describe

    return describe(t.customer).where(F.col("column_name").isin("c_name", "c_mktsegment"))


@query("s06_version_probe", "SELECT count(*) AS n_rows, true AS has_segment, false AS has_region FROM customer")
def _(t):
    from ..sources.tables import has_columns

    c = t.customer
    return c.agg(F.count("*").alias("n_rows")).withColumn("has_segment", F.lit(has_columns(c, "c_mktsegment"))).withColumn("has_region", F.lit(has_columns(c, "c_region")))


@query("s15_missing_columns", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


# ---- joins -------------------------------------------------------------------------------------------
@query("j01_star_join_top", """SELECT o_orderkey, c_name, n_name, l.n_lines FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey ORDER BY o_orderkey DESC LIMIT 300""")
def _(t):
    newest = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    newest = newest.select("o_orderkey", "c_name", "n_name").orderBy(F.desc("o_orderkey")).limit(300)
    # only the lines of the 300 orders are counted
    few = F.broadcast(newest.select(F.col("o_orderkey").alias("l_orderkey")))
    lines = t.lineitem.select("l_orderkey").join(few, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return newest.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "c_name", "n_name", "n_lines")


@query("j02_inner_join", "SELECT o_orderkey, o_orderstatus, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def _(t):
    return t.orders.where("o_orderstatus = 'O'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "c_custkey", "c_mktsegment")


@query("j03_lookup_chain", "SELECT o_orderkey, c_name AS customer_name, n_name AS nation_name, r_name AS region_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    o, c, n, r = t.orders.alias("o"), t.customer.alias("c"), t.nation.alias("n"), t.region.alias("r")
    chain = o.join(c, F.expr("o_custkey = c_custkey"), "left").join(n, F.expr("c_nationkey = n_nationkey"), "left").join(r, F.expr("n_regionkey = r_regionkey"), "left")
    return chain.select("o_orderkey", F.col("c.c_name").alias("customer_name"), F.col("n.n_name").alias("nation_name"), F.col("r.r_name").alias("region_name"))


@query("j04_literal_product", "SELECT r_name, w AS wrong, c AS correct FROM region CROSS JOIN (VALUES ('O', '0'), ('l', '1'), ('S', '5')) v(w, c)")
def _(t):
    pairs = F.array(*[F.struct(F.lit(w).alias("wrong"), F.lit(c).alias("correct")) for w, c in (("O", "0"), ("l", "1"), ("S", "5"))])
    return t.region.select("r_name", F.inline(pairs))


@query("j05_composite_left_join", """SELECT l_orderkey, l_linenumber, l_quantity, s.l_shipdate IS NOT NULL AS detected FROM lineitem LEFT JOIN (SELECT DISTINCT l_orderkey AS ok, l_linenumber AS ln, l_shipdate FROM lineitem WHERE l_returnflag = 'R') s
 ON ok = l_orderkey AND ln = l_linenumber AND s.l_shipdate = lineitem.l_shipdate""")
def _(t):
    seen = t.lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_shipdate").distinct().withColumn("_hit", F.lit(True))
    joined = t.lineitem.join(seen, ["l_orderkey", "l_linenumber", "l_shipdate"], "left")
    return joined.select("l_orderkey", "l_linenumber", "l_quantity", F.col("_hit").isNotNull().alias("detected"))


@query("j07_interval_join", """SELECT a.event_id AS error_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase'
 AND b.ts::DATE - a.ts::DATE BETWEEN 0 AND 3""")
def _(t):
    from ..operators.joins import day_range_join

    e = t.events.select("event_id", "user_id", "event_type", "ts")
    a = e.where(F.col("event_type") == "error").select(F.col("event_id").alias("error_id"), "user_id", F.to_date("ts").alias("day_a"))
    b = e.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("purchase_id"), "user_id", F.to_date("ts").alias("day_b"))
    return day_range_join(a, b, ["user_id"], "day_a", "day_b", 0, 3).select("error_id", "purchase_id")


@query("j10_neighbour_join", "SELECT a.conv_id, a.turn, b.turn AS near_turn, b.role AS near_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1")
def _(t):
    from ..operators.joins import band_join

    a = t.conversations.select("conv_id", "turn")
    b = t.conversations.select("conv_id", F.col("turn").alias("near_turn"), F.col("role").alias("near_role"))
    return band_join(a, b, ["conv_id"], "turn", "near_turn", 1)


@query("j11_best_neighbour", """SELECT cell, near, similarity FROM (SELECT a.cell, b.cell AS near, levenshtein(a.truth, b.truth) AS similarity,
  row_number() OVER (PARTITION BY a.cell ORDER BY levenshtein(a.truth, b.truth), b.cell) AS rn
  FROM (SELECT p_partkey AS cell, p_partkey // 8 AS page, p_partkey % 8 AS row, p_name AS truth FROM part) a JOIN (SELECT p_partkey AS cell, p_partkey // 8 AS page, p_partkey % 8 AS row, p_name AS truth FROM part) b
  ON a.page = b.page AND abs(a.row - b.row) <= 1 AND a.cell <> b.cell) WHERE rn = 1""")
def _(t):
    from ..operators.joins import band_join

    base = t.part.select(F.floor(F.col("p_partkey") / 8).alias("page"), (F.col("p_partkey") % 8).alias("row"), F.col("p_partkey").alias("cell"), F.col("p_name").alias("truth"))
    other = base.select("page", F.col("row").alias("near_row"), F.col("cell").alias("near"), F.col("truth").alias("near_truth"))
    pairs = band_join(base, other, ["page"], "row", "near_row", 1).where("cell <> near").withColumn("similarity", F.levenshtein("truth", "near_truth"))
    best = pairs.groupBy("cell").agg(F.min(F.struct("similarity", "near")).alias("b"))
    return best.select("cell", "b.near", F.col("b.similarity").cast("long").alias("similarity"))


@query("j12_wildcard_rules", """SELECT o_orderkey, verdict FROM (SELECT o_orderkey, v.verdict, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN v.priority = '*' THEN 1 ELSE 0 END) AS rn FROM orders
 LEFT JOIN (VALUES ('F', '1-URGENT', 'late'), ('F', '*', 'done'), ('O', '*', 'open'), ('O', '5-LOW', 'waits')) v(status, priority, verdict) ON v.status = o_orderstatus AND v.priority IN ('*', o_orderpriority)) WHERE rn = 1""")
def _(t):
    from ..operators.joins import wildcard_rules

    rules = [("F", "1-URGENT", "late"), ("F", "*", "done"), ("O", "*", "open"), ("O", "5-LOW", "waits")]
    return t.orders.select("o_orderkey", wildcard_rules([F.col("o_orderstatus"), F.col("o_orderpriority")], rules).alias("verdict"))


@query("j13_previous_value", """SELECT conv_id, turn, (SELECT arg_max(b.role, b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.role <> 'system') AS previous_role FROM conversations a""")
def _(t):
    return W.fill_down(t.conversations, ["conv_id"], [F.col("turn")], F.col("role"), F.col("role") == "system", "previous_role", own=False).select("conv_id", "turn", "previous_role")


@query("j14_keyed_zip", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity AS first_read, b.l_quantity AS second_read FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) b USING (l_orderkey, l_linenumber)")
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("first_read"), F.max("l_quantity").alias("second_read"))


@query("j15_count_changes", f"""SELECT user_id, event_type, greatest(coalesce(n, 0) - coalesce(o, 0), 0) AS added, greatest(coalesce(o, 0) - coalesce(n, 0), 0) AS removed FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE NOT ({MONTH1}) GROUP BY 1, 2) a
 FULL JOIN (SELECT user_id, event_type, count(*) AS o FROM events WHERE {MONTH1} GROUP BY 1, 2) b USING (user_id, event_type) WHERE coalesce(n, 0) <> coalesce(o, 0)""")
def _(t):
    early = F.expr(MONTH1)
    count = lambda df: df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return K.changes(count(t.events.where(~early)), count(t.events.where(early)), ["user_id", "event_type"], "n")


@query("j16_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j18_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("j19_lineage_inversion", "SELECT p_brand AS pattern, list_sort(list(DISTINCT l_suppkey)) AS taught_by FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1")
def _(t):
    used = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select("l_partkey", "l_suppkey")
    named = used.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return named.groupBy(F.col("p_brand").alias("pattern")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("taught_by"))


@query("j20_star_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("j21_family_self_join", "SELECT p.o_custkey AS custkey, p.o_orderkey AS first_order, c.o_orderkey AS later_order FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) p JOIN orders c ON p.o_custkey = c.o_custkey AND c.o_orderkey > p.o_orderkey")
def _(t):
    first = Window.partitionBy("o_custkey")
    return t.orders.select(F.col("o_custkey").alias("custkey"), F.min("o_orderkey").over(first).alias("first_order"), F.col("o_orderkey").alias("later_order")).where("later_order > first_order")


@query("j24_join_strategies", "SELECT o_orderkey, c_name, l_linenumber FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def _(t):
    """A strategy named where the optimizer's choice is not wanted: hashing by shuffle, then sort and merge."""
    hashed = t.orders.join(t.customer.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey"))
    return hashed.join(t.lineitem.where("l_returnflag = 'R'").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "c_name", "l_linenumber")


# ---- windows -----------------------------------------------------------------------------------------
@query("w01_fill_down_before", "SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_value FROM events")
def _(t):
    return W.fill_down(t.events, ["user_id"], [F.col("event_id")], F.col("value"), F.col("event_type") == "error", "earlier_value", own=False).select("event_id", "earlier_value")


@query("w02_fill_down_own", "SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS filled FROM events")
def _(t):
    return W.fill_down(t.events, ["user_id"], [F.col("event_id")], F.col("event_type"), F.col("event_type") == "error", "filled", default=F.lit("")).select("event_id", "filled")


@query("w03_latest_per_key", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return W.latest(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("w04_position_in_group", "SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS place FROM lineitem QUALIFY place <= 3")
def _(t):
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_shipdate")]
    return W.ranked(t.lineitem, ["l_orderkey"], order).where("place <= 3").select("l_orderkey", "l_partkey", "l_linenumber", "place")


@query("w05_lag_lead_best", """SELECT cell, abs(own - 20) AS d_own, abs(above - 20) AS d_above, abs(below - 20) AS d_below FROM (SELECT p_partkey AS cell, p_size AS own, lag(p_size) OVER w AS above, lead(p_size) OVER w AS below FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))""")
def _(t):
    scored = W.best_neighbour(t.part, ["p_brand"], F.col("p_partkey"), F.col("p_size"), lambda v: F.abs(v - 20), ("d_own", "d_above", "d_below"))
    return scored.select(F.col("p_partkey").alias("cell"), "d_own", "d_above", "d_below")


@query("w06_carry_over", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS carried_role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS carried_turn FROM conversations")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.withColumn("c", F.lag(F.struct("role", "turn")).over(w)).select("conv_id", "turn", F.col("c.role").alias("carried_role"), F.col("c.turn").alias("carried_turn"))


@query("w07_ordinal_counter", "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS exchange FROM conversations")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("exchange"))


@query("w08_islands", """SELECT user_id, island::BIGINT AS island, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2""")
def _(t):
    e = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    runs = W.islands(e, ["user_id"], F.col("us"), 21_600_000_000)
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("w09_median_gap", "SELECT user_id, median(gap) AS median_gap FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) GROUP BY 1")
def _(t):
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.median("gap").alias("median_gap"))


@query("w10_moving_average", "SELECT event_id, sum(value::DECIMAL(18,2)) OVER w AS moving_sum, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 2)
    return t.events.select("event_id", F.sum(F.col("value").cast(DEC)).over(w).cast("decimal(38,2)").alias("moving_sum"), F.count("*").over(w).alias("n"))


@query("w11_previous_word", """SELECT doc_id, count(*) AS n_after_the FROM (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)) WHERE lower(p) = 'the' GROUP BY 1""")
def _(t):
    words = F.split("text", " ")
    n = F.aggregate(words, F.struct(F.lit("").alias("p"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("p"), (a["n"] + F.when(F.lower(a["p"]) == "the", 1).otherwise(0)).alias("n")), lambda a: a["n"])
    return t.documents.select("doc_id", n.cast("long").alias("n_after_the")).where("n_after_the > 0")


@query("w12_equal_share", "SELECT l_orderkey, l_linenumber, l_partkey, (sum(l_quantity::DECIMAL(18,2)) OVER (PARTITION BY l_orderkey))::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS share FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey")
    total = F.sum(F.col("l_quantity").cast(DEC)).over(w).cast("double")
    return W.share_equally(t.lineitem, ["l_orderkey"], total, "share").select("l_orderkey", "l_linenumber", "l_partkey", "share")


@query("w13_ranked_candidates", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 5")
def _(t):
    return W.ranked(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderkey")]).where("place <= 5").select("o_custkey", "o_orderkey", "place")


@query("w14_jobs_ahead", "SELECT o_orderkey, coalesce(count(*) FILTER (o_orderstatus <> 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return t.orders.select("o_orderkey", F.count_if(F.col("o_orderstatus") != "F").over(w).alias("ahead"))


@query("w15_rank_frames", """SELECT o_orderkey, ntile(4) OVER w AS quarter, cume_dist() OVER w AS below, percent_rank() OVER w AS share, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS alike FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)""")
def _(t):
    keys = ["o_orderpriority"]
    near = W.count_within(t.orders, keys, "o_totalprice", 1000, "alike").select(F.col("o_orderpriority").alias("_p"), F.col("o_totalprice").alias("_v"), "alike")
    placed = W.ranks(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), keys, ["o_totalprice", "o_orderkey"], 4)
    found = placed.join(near, F.col("o_orderpriority").eqNullSafe(F.col("_p")) & F.col("o_totalprice").eqNullSafe(F.col("_v")))
    return found.select("o_orderkey", F.col("tile").alias("quarter"), "below", "share", "alike")


# ---- order and top-k ---------------------------------------------------------------------------------
@query("t01_newest_rows", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 300")
def _(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderkey")).limit(300)


@query("t02_two_keys", "SELECT p_partkey, p_brand, p_size FROM part")
def _(t):
    return t.part.select("p_partkey", "p_brand", "p_size").orderBy("p_brand", "p_size", "p_partkey")


@query("t03_boolean_first", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F'), o_orderkey DESC) AS place FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") != "F", F.desc("o_orderkey"))
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("t04_blank_last", "SELECT cell, row_number() OVER (PARTITION BY page ORDER BY raw DESC NULLS LAST, cell) AS place FROM (SELECT p_partkey AS cell, p_partkey // 8 AS page, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS raw FROM part)")
def _(t):
    base = t.part.select(F.col("p_partkey").alias("cell"), F.floor(F.col("p_partkey") / 8).alias("page"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("raw"))
    return base.select("cell", F.row_number().over(Window.partitionBy("page").orderBy(F.desc_nulls_last("raw"), "cell")).cast("long").alias("place"))


@query("t05_top_one", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def _(t):
    return W.latest(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice"), -F.col("p_partkey")])


@query("t06_alternatives", "SELECT p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) BETWEEN 2 AND 4 AND p_retailprice >= 900")
def _(t):
    first = W.top(t.part, ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 4)
    return W.ranked(first, ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")]).where("place >= 2 and p_retailprice >= 900").select("p_type", "p_partkey", "p_retailprice")


@query("t07_custom_order", "SELECT o_orderkey, list_position(['O', 'P', 'F'], o_orderstatus)::BIGINT AS step FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.array_position(F.array(*map(F.lit, "OPF")), F.col("o_orderstatus")).alias("step"))


@query("t08_longest_first", "SELECT p_name, row_number() OVER (ORDER BY length(p_name) DESC, p_name) AS place FROM (SELECT DISTINCT p_name FROM part)")
def _(t):
    names = t.part.select("p_name").distinct()
    return W.numbered(names, [F.desc(F.length("p_name")), F.col("p_name")]).select("p_name", F.col("place").cast("long").alias("place"))


@query("t09_bounded_list", "SELECT user_id, list_slice(list(event_id ORDER BY event_id DESC), 1, 30) AS newest FROM events GROUP BY 1")
def _(t):
    return W.top(t.events, ["user_id"], [F.desc("event_id")], 30).groupBy("user_id").agg(F.sort_array(F.collect_list("event_id"), asc=False).alias("newest"))


# ---- sets --------------------------------------------------------------------------------------------
@query("u01_union_all", "SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind")).union(t.supplier.select("s_nationkey", F.lit("supplier")))


@query("u02_union_with_source", "SELECT kind, count(*) AS n FROM (SELECT 'part' AS kind, p_name AS v FROM part UNION ALL SELECT 'customer', c_name FROM customer) GROUP BY 1")
def _(t):
    both = t.part.select(F.lit("part").alias("kind"), F.col("p_name").alias("v")).unionByName(t.customer.select(F.lit("customer").alias("kind"), F.col("c_name").alias("v")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("u03_distinct_in_order", "SELECT conv_id, list(role ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(t):
    turns = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return turns.select("conv_id", F.array_distinct(F.col("x.role")).alias("roles"))


@query("u04_set_algebra", "SELECT a.c_nationkey AS nationkey FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') a JOIN (SELECT DISTINCT s_nationkey FROM supplier) b ON a.c_nationkey = b.s_nationkey")
def _(t):
    return t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_nationkey").alias("nationkey")).intersect(t.supplier.select("s_nationkey"))


@query("u05_set_difference", "SELECT DISTINCT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    return t.part.select("p_partkey").subtract(t.lineitem.where(F.col("l_returnflag") == "R").select("l_partkey"))


@query("u07_sql_sets", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)")
def _(t):
    c, s, n = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey"), t.nation.select("n_nationkey")
    return c.intersect(s).unionAll(n.subtract(c))


@query("u06_subset_test", "SELECT user_id, bool_and(event_type IN ('view', 'click', 'purchase', 'signup')) AS within FROM events WHERE value > 50 GROUP BY 1")
def _(t):
    kinds = t.events.where("value > 50").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    allowed = F.array(*map(F.lit, ("view", "click", "purchase", "signup")))
    return kinds.select("user_id", (F.size(F.array_except("k", allowed)) == 0).alias("within"))


# ---- keyed stores ------------------------------------------------------------------------------------
@query("k01_insert_projection", "SELECT c_custkey AS id, upper(c_name) AS name FROM customer WHERE c_acctbal > 5000")
def _(t):
    from ..sources.tables import whitelist

    return whitelist(t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name")), ["id", "name"])


@query("k02_update_by_key", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    new = t.customer.where("c_acctbal > 5000").select("c_custkey", F.lit("MOVED").alias("c_mktsegment"))
    return K.overlay(t.customer.select("c_custkey", "c_mktsegment"), new, ["c_custkey"], ["c_mktsegment"])


@query("k03_counting_upsert", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    early = F.expr(MONTH1)
    count = lambda df: df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return K.counting_upsert(count(t.events.where(early)), count(t.events.where(~early)), ["user_id", "event_type"], ["n"])


@query("k04_upsert_two_counters", f"SELECT user_id, count(*) FILTER ({MONTH1}) AS from_first, count(*) FILTER (NOT ({MONTH1})) AS from_second, arg_max(event_type, event_id) AS shown, max(event_id) AS seq FROM events GROUP BY 1")
def _(t):
    early = F.expr(MONTH1)
    side = lambda df, a, b: df.groupBy("user_id").agg((F.count("*") if a else F.lit(0).cast("long")).alias("from_first"), (F.count("*") if b else F.lit(0).cast("long")).alias("from_second"), F.max_by("event_type", "event_id").alias("shown"), F.max("event_id").alias("seq"))
    return K.counting_upsert(side(t.events.where(early), 1, 0), side(t.events.where(~early), 0, 1), ["user_id"], ["from_first", "from_second"], last=["shown"], seq="seq")


@query("k05_uncount", f"SELECT user_id, event_type, count(*) FILTER (NOT ({MONTH1})) AS n FROM events GROUP BY 1, 2")
def _(t):
    count = lambda df: df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return K.uncount(count(t.events), count(t.events.where(F.expr(MONTH1))), ["user_id", "event_type"], "n")


@query("k06_upsert_keep_name", "SELECT o_custkey AS id, coalesce(arg_max(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, ''), o_orderkey) , '') AS name, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def _(t):
    name = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.coalesce(F.max_by(name, F.when(name.isNotNull(), F.col("o_orderkey"))), F.lit("")).alias("name"), F.max_by("o_totalprice", "o_orderkey").alias("price"))


@query("k07_insert_ignore", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 50, s_name FROM supplier WHERE s_suppkey + 50 NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return K.insert_ignore(old, t.supplier.select((F.col("s_suppkey") + 50).alias("id"), F.col("s_name").alias("name")), ["id"])


@query("k08_upsert_source", "SELECT n_nationkey AS id, (n_nationkey + coalesce(s.n, 0))::BIGINT AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def _(t):
    old = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("n"))
    new = t.supplier.groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("n"))
    return K.counting_upsert(old, new, ["id"], ["n"])


@query("k09_next_sort_order", "SELECT p_brand, coalesce(max(p_size), 0) + 10 AS next_order FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg((F.coalesce(F.max("p_size"), F.lit(0)) + 10).alias("next_order"))


@query("k10_cascade_delete", "SELECT c_custkey FROM customer WHERE NOT (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F'))")
def _(t):
    children = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    parents, _ = K.cascade_delete(t.customer.select("c_custkey"), children, children.where("o_orderstatus = 'F'"), "o_orderkey", "c_custkey")
    return parents


@query("k11_exclusive_move", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'moved' ELSE 'none' END AS head, CASE WHEN conv_id % 2 = 0 THEN len(list_filter(list(role ORDER BY turn), lambda r: r <> 'system')) + 1 ELSE count(*) END::BIGINT AS n FROM conversations GROUP BY conv_id")
def _(t):
    per = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x")).withColumn("roles", F.col("x.role"))
    even = F.col("conv_id") % 2 == 0
    moved = F.array_prepend(F.filter("roles", lambda r: r != "system"), F.lit("moved"))
    return per.select("conv_id", F.when(even, F.element_at(moved, 1)).otherwise("none").alias("head"), F.when(even, F.size(moved)).otherwise(F.size("roles")).cast("long").alias("n"))


@query("k12_replace_by_key", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey, 'X' || n_name FROM nation WHERE n_regionkey = 2")
def _(t):
    old = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return K.replace_by_key(old, t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("X"), "n_name").alias("name")), ["id"])


@query("k13_append_running_id", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def _(t):
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return K.appended(old, t.nation.select(F.col("n_name").alias("name")), [F.col("name")], "id")


@query("k15_forward_only_status", "SELECT o_custkey, ['O', 'P', 'F'][max(list_position(['O', 'P', 'F'], o_orderstatus))] AS status FROM orders GROUP BY 1")
def _(t):
    bounds = t.orders.groupBy("o_custkey").agg(*[F.max_by("o_orderstatus", F.array_position(F.array(*map(F.lit, "OPF")), F.col("o_orderstatus")) * s).alias(n) for s, n in ((1, "a"), (-1, "b"))])
    return bounds.select("o_custkey", K.forward_only(list("OPF"), F.col("b"), F.col("a")).alias("status"))


@query("k20_merge_update", "SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN upper(s_name) END, s_name) AS s_name, [s_suppkey, s_nationkey::BIGINT] AS log FROM supplier")
def _(t):
    new = t.supplier.where("s_acctbal > 0").select("s_suppkey", F.upper("s_name").alias("s_name"))
    merged = K.overlay(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), new, ["s_suppkey"], ["s_name"])
    return merged.select("s_suppkey", "s_name", F.array_append(F.array("s_suppkey"), F.col("s_nationkey").cast("long")).alias("log"))


@query("k23_age_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' OR user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def _(t):
    keep = t.events.where("event_type = 'purchase' and value > 90").select("user_id")
    stale = t.events.where("ts < TIMESTAMP '2024-01-10 00:00:00'").join(keep, "user_id", "left_anti").select("event_id")
    return t.events.select("event_id").join(stale, "event_id", "left_anti")


@query("k24_packed_names", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS packed FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), "|").alias("packed"))


@query("a30_checksum", "SELECT count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws(chr(31), o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderkey, o_orderpriority, o_orderstatus, o_totalprice)), 1, 12))::BIGINT)::DECIMAL(30,0) AS checksum FROM orders")
def _(t):
    return K.checksum(t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))


@query("n04_prepend_unique", "SELECT conv_id, list(role ORDER BY k) AS roles FROM (SELECT conv_id, role, min(k) AS k FROM (SELECT conv_id, role, turn AS k FROM conversations UNION ALL SELECT DISTINCT conv_id, 'assistant', -1 FROM conversations) GROUP BY 1, 2) GROUP BY 1")
def _(t):
    per = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return per.select("conv_id", K.prepend_unique(F.array_distinct(F.col("x.role")), F.lit("assistant"), 30).alias("roles"))
