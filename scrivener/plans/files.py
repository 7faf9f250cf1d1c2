"""Queries: files written and read again, and streams over event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks, tables
from ..streaming import windows as S
from .base import query


@query("s07_json_folder", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    path = sinks.write_json(t.nation, sinks.scratch(t.spark, "json"))
    return t.spark.read.json(path, schema="n_nationkey int, n_name string, n_regionkey int")


@query("s09_newest_documents", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    path = sinks.write_json(t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice"), sinks.scratch(t.spark, "json"))
    return t.spark.read.json(path, schema="o_orderkey long, o_totalprice double").orderBy(F.desc("o_orderkey"))


@query("s10_csv_with_header", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 7 <> 0")
def _(t):
    blanked = t.supplier.select(F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey").cast("string")).otherwise(" ").alias("s_suppkey"), "s_name")
    path = sinks.write_csv(blanked, sinks.scratch(t.spark, "csv"))
    return tables.csv_table(t.spark, path, "s_suppkey string, s_name string", key="s_suppkey").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@query("s11_rule_file", "SELECT o_orderkey, o_orderstatus, [o_orderkey % 5, o_orderkey % 5 + 1, o_orderkey % 5 + 2, o_orderkey % 5 + 9] AS rows_hit FROM orders")
def _(t):
    k = F.col("o_orderkey") % 5
    spec = F.concat(k, F.lit("-"), k + 2, F.lit(","), k + 9)
    return t.orders.select("o_orderkey", "o_orderstatus", F.transform(tables.row_ranges(spec), lambda x: x.cast("long")).alias("rows_hit"))


@query("s12_digest_of_table", "SELECT p_brand, sha256(string_agg(p_partkey || ':' || p_name, chr(10) ORDER BY p_partkey)) AS digest FROM part GROUP BY 1")
def _(t):
    lines = t.part.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.concat("p_partkey", F.lit(":"), "p_name").alias("l")))).alias("x"))
    return lines.select("p_brand", F.sha2(F.array_join(F.transform("x", lambda e: e["l"]), "\n"), 256).alias("digest"))


@query("s13_weights_lookup", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END AS weight FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    from ..functions.text import recode

    return t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", recode(F.col("o_orderpriority"), {"1-URGENT": 3, "2-HIGH": 2}, F.lit(1)).alias("weight"))


@query("s16_clean_key_table", "SELECT c_custkey, upper(trim(c_name)) AS name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(t):
    return t.customer.where("c_mktsegment <> 'BUILDING'").select("c_custkey", F.upper(F.trim("c_name")).alias("name"), "c_mktsegment")


@query("s21_reference_json", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    path = sinks.write_json(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"), sinks.scratch(t.spark, "places"))
    return t.spark.read.json(path, schema="n_name string, r_name string")


@query("s23_default_table", "SELECT r_regionkey, r_name FROM region")
def _(t):
    return tables.or_default(t.region.where("r_regionkey > 100"), t.region)


@query("k14_truncate", "SELECT c_custkey, c_name FROM customer WHERE false")
def _(t):
    return sinks.truncate(t.customer.select("c_custkey", "c_name"))


@query("k16_sheets", "SELECT p_partkey, '''' || '=' || p_name AS v FROM part")
def _(t):
    paths = sinks.write_sheets({"part/names": t.part.select("p_partkey", F.concat(F.lit("="), "p_name").alias("v"))}, sinks.scratch(t.spark, "sheets"))
    return t.spark.read.csv(paths["part/names"], header=True, schema="p_partkey long, v string")


@query("k17_sorted_export", "SELECT c_acctbal, c_custkey, c_name FROM customer")
def _(t):
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    path = sinks.write_csv(c.select(*sorted(c.columns)), sinks.scratch(t.spark, "export"))
    return t.spark.read.csv(path, header=True, schema="c_acctbal double, c_custkey long, c_name string")


@query("k18_partitioned_json", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    path = sinks.write_json(t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n")), sinks.scratch(t.spark, "runs"), by=["event_type"])
    return t.spark.read.json(path, schema="user_id long, n long, event_type string").select("event_type", "user_id", "n")


@query("k19_atomic_json", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return t.spark.read.json(sinks.write_json(t.supplier.select("s_suppkey", "s_name"), sinks.scratch(t.spark, "atomic")), schema="s_suppkey long, s_name string")


@query("k21_collected_summaries", "SELECT 'orders' AS test, count(*) AS n, NULL::BIGINT AS n_users FROM orders UNION ALL SELECT 'events', count(*), count(DISTINCT user_id) FROM events")
def _(t):
    return sinks.collect_summaries({"orders": t.orders.agg(F.count("*").alias("n")), "events": t.events.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))}).select("test", "n", "n_users")


@query("st1_windowed_counts", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DECIMAL(28,2) AS total FROM events GROUP BY 1, 2")
def _(t):
    counts = S.windowed_counts(S.event_stream(t.spark, t.folder, "events"), ["event_type"])
    done = S.drain(counts, "windows")
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.col("total").cast("decimal(28,2)").alias("total"))


@query("st2_sessions", """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _(t):
    done = S.drain(S.sessions(S.event_stream(t.spark, t.folder, "events"), ["user_id"]), "sessions")
    return done.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("st3_first_seen", "SELECT event_id, event_type FROM events")
def _(t):
    stream = S.event_stream(t.spark, t.folder, "events")
    return S.drain(S.first_seen(stream.union(stream), ["event_id"]).select("event_id", "event_type"), "first", mode="append")
