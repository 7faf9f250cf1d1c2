"""Queries: page layout over token and line tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as Y
from .base import query, spread

#: Twelve events are a page's heading words; unnamed words have a null category.
TOKENS = "tok AS (SELECT event_id // 12 AS page, event_id, event_id * 37 % 1000 AS x0, event_id * 37 % 1000 + 20 + event_id % 30 AS x1, nullif(event_type, 'error') AS category FROM events)"
RULES = "rules AS (SELECT DISTINCT page, x FROM (SELECT page, (page * 53 + k * 211) % 1000 AS x FROM (SELECT DISTINCT page FROM tok), range(1, 4) r(k)) WHERE x > 30 AND x < 970)"
CLUSTERS = """m AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tok),
 n AS (SELECT *, sum(CASE WHEN before IS NULL OR x0 - before >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, event_id) AS cluster FROM m),
 cl AS (SELECT page, cluster, min(x0) AS x0, max(x1) AS x1, CASE WHEN count(DISTINCT category) = 1 THEN max(category) END AS category FROM n GROUP BY 1, 2)"""
LEFT, RIGHT = ("view", "click"), ("purchase", "signup")
EXPECTED = ("view", "click", "purchase", "signup")


def tokens(t):
    e, x = F.col("event_id"), F.col("event_id") * 37 % 1000
    return t.events.select(F.floor(e / 12).alias("page"), "event_id", x.alias("x0"), (x + 20 + e % 30).alias("x1"), F.nullif("event_type", F.lit("error")).alias("category"))


def rules(t):
    pages = tokens(t).select("page").distinct()
    return pages.select("page", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: ((F.col("page") * 53 + k * 211) % 1000).cast("double"))).alias("x")).where("x > 30 and x < 970").distinct()


SIDES = "CASE WHEN count(*) FILTER (category IN ('view', 'click')) > count(*) FILTER (category IN ('purchase', 'signup')) THEN 'left' WHEN count(*) FILTER (category IN ('view', 'click')) < count(*) FILTER (category IN ('purchase', 'signup')) THEN 'right' END AS side"


@query("x21_guessed_side", f"WITH {TOKENS} SELECT page, {SIDES} FROM tok GROUP BY 1")
def _(t):
    return Y.guessed_side(tokens(t), ["page"], "category", LEFT, RIGHT)


@query("x20_majority_side", f"""WITH {TOKENS}, s AS (SELECT page, {SIDES} FROM tok GROUP BY 1), p AS (SELECT page // 8 AS document, CASE side WHEN 'left' THEN 'odd' WHEN 'right' THEN 'even' END AS said, CASE WHEN page % 2 = 1 THEN 'odd' ELSE 'even' END AS parity FROM s)
 SELECT document, (count(*) FILTER (said <> parity) > count(*) FILTER (said = parity))::INTEGER AS turned FROM p GROUP BY 1""")
def _(t):
    sides = Y.guessed_side(tokens(t), ["page"], "category", LEFT, RIGHT)
    said = F.when(F.col("side") == "left", "odd").when(F.col("side") == "right", "even")
    pages = sides.select(F.floor(F.col("page") / 8).alias("document"), said.alias("said"), F.when(F.col("page") % 2 == 1, "odd").otherwise("even").alias("parity"))
    return Y.majority_side(pages, ["document"], "said", "parity")


@query("x22_heading_clusters", f"WITH {TOKENS}, {CLUSTERS} SELECT page, cluster::BIGINT AS cluster, x0, x1, category FROM cl")
def _(t):
    return Y.heading_clusters(tokens(t), "page", "event_id", 15)


@query("x23_proposed_columns", f"""WITH {TOKENS}, {RULES}, {CLUSTERS},
 g AS (SELECT page, x0, x1, category, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1, lead(category) OVER w AS ncat FROM cl WINDOW w AS (PARTITION BY page ORDER BY cluster)),
 o AS (SELECT page, coalesce(category <> ncat, false) AS differ, nx0 - x1 AS gap, (x1 + nx0) / 2.0::DOUBLE AS x, (SELECT count(*) FROM rules r WHERE r.page = g.page) AS n FROM g
   WHERE nx0 > x1 AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.page = g.page AND r.x > (x0 + x1) / 2.0 AND r.x < (nx0 + nx1) / 2.0)),
 k AS (SELECT *, row_number() OVER (PARTITION BY page, differ ORDER BY gap DESC, x DESC) AS rank, count(*) FILTER (differ) OVER (PARTITION BY page) AS sure FROM o),
 d AS (SELECT page, x::DOUBLE AS x FROM rules UNION SELECT page, x FROM k WHERE differ OR (gap >= 20 AND rank <= 3 - n - sure)),
 e AS (SELECT page, x FROM d UNION ALL SELECT DISTINCT page, 0.0::DOUBLE FROM tok),
 c AS (SELECT page, x, row_number() OVER w - 1 AS col, lead(x, 1, 1000.0) OVER w AS right_x FROM e WINDOW w AS (PARTITION BY page ORDER BY x)),
 i AS (SELECT page, col, category, count(*) AS n FROM tok JOIN c USING (page) WHERE category IS NOT NULL AND (x0 + x1) / 2.0 >= x AND (x0 + x1) / 2.0 < right_x GROUP BY 1, 2, 3),
 f AS (SELECT page, category, min(col) AS col FROM (SELECT page, col, category FROM i QUALIFY row_number() OVER (PARTITION BY page, col ORDER BY n DESC, category) = 1) GROUP BY 1, 2),
 u AS (SELECT p.page, v.category, row_number() OVER (PARTITION BY p.page ORDER BY v.o) AS place FROM (SELECT DISTINCT page FROM tok) p, (VALUES (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'signup')) v(o, category) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.page = p.page AND f.category = v.category)),
 z AS (SELECT c.page, c.col, c.x, f.category, count(*) FILTER (f.category IS NULL) OVER (PARTITION BY c.page ORDER BY c.col) AS place FROM c LEFT JOIN f USING (page, col))
 SELECT z.page, z.col::INTEGER AS col, CASE WHEN z.col = 0 THEN 0.01::DOUBLE ELSE round(z.x / 1000, 4) END AS "left", coalesce(z.category, u.category, '') AS category FROM z LEFT JOIN u ON z.category IS NULL AND u.page = z.page AND u.place = z.place""")
def _(t):
    tok, printed = tokens(t), rules(t)
    edges = Y.dividers(Y.heading_clusters(tok, "page", "event_id", 15), printed, "page", len(EXPECTED), 20)
    return Y.named_columns(edges, tok, "page", 1000.0, EXPECTED)


@query("x24_best_template", """WITH s AS (SELECT c_custkey, n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'odd' WHEN 1 THEN 'even' ELSE 'current' END IN ('current', CASE WHEN c_custkey % 2 = 1 THEN 'odd' ELSE 'even' END) AS fits,
   1 - abs(floor(c_acctbal)::INTEGER % 25 - n_nationkey)::DOUBLE / 12 AS score FROM customer JOIN (SELECT n_nationkey AS own, n_regionkey AS region FROM nation) ON own = c_nationkey JOIN nation ON n_regionkey = region),
 e AS (SELECT *, bool_or(fits) OVER (PARTITION BY c_custkey) AS any_fits FROM s)
 SELECT c_custkey, CASE WHEN max(score) > 0 THEN arg_max(n_nationkey, {'score': score, 'key': -n_nationkey}) END AS template, greatest(0.0, max(score)) AS score FROM e WHERE fits OR NOT any_fits GROUP BY 1""")
def _(t):
    own = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    parity = F.when(F.col("n_nationkey") % 3 == 0, "odd").when(F.col("n_nationkey") % 3 == 1, "even").otherwise("current")
    pairs = t.customer.join(own, "c_nationkey").join(t.nation, F.col("n_regionkey") == F.col("region"))
    fits = parity.isin("current") | (parity == F.when(F.col("c_custkey") % 2 == 1, "odd").otherwise("even"))
    scored = pairs.select("c_custkey", "n_nationkey", fits.alias("fits"), (1 - F.abs(F.floor("c_acctbal").cast("int") % 25 - F.col("n_nationkey")) / 12).alias("score"))
    best = lambda ok: F.max(F.when(ok, F.struct("score", (-F.col("n_nationkey")).alias("k"))))
    top = scored.groupBy("c_custkey").agg(F.coalesce(best(F.col("fits")), best(F.lit(True))).alias("b"))
    return top.select("c_custkey", F.when(F.col("b.score") > 0, -F.col("b.k")).alias("template"), F.greatest(F.lit(0.0), F.col("b.score")).alias("score"))


@query("x25_offset_search", """WITH p AS (SELECT p_partkey, list_transform(range(0, 5), lambda k: 100 + k * (60 + p_size)) AS tpl, list_transform(range(0, 6), lambda k: 100 + k * (60 + p_size) + p_partkey % 61 - 30 + (k * 7 + p_partkey) % 9 + CASE WHEN (k + p_partkey) % 6 = 0 THEN 40 ELSE 0 END) AS det FROM part),
 o AS (SELECT p_partkey, off.off AS off, list_filter(list_transform(tpl, lambda x: list_min(list_transform(det, lambda d: abs(x + off.off - d)))), lambda x: x < 15) AS near FROM p, range(-50, 51) off(off))
 SELECT p_partkey, len(near)::INTEGER AS matches, coalesce(list_sum(near), 0)::BIGINT AS error, CASE WHEN len(near) = 0 THEN 0 ELSE off END::INTEGER AS shift FROM o QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY len(near) DESC, coalesce(list_sum(near), 0), off) = 1""")
def _(t):
    key, step = F.col("p_partkey"), F.lit(60) + F.col("p_size")
    template = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.lit(100) + k * step)
    found = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.lit(100) + k * step + key % 61 - 30 + (k * 7 + key) % 9 + F.when((k + key) % 6 == 0, 40).otherwise(0))
    best = spread(t.part.select("p_partkey", "p_size"), "p_partkey").select("p_partkey", Y.best_offset(template, found, 50, 15).alias("b"))
    return best.select("p_partkey", "b.matches", "b.error", F.col("b.offset").alias("shift"))


LINES = "ln AS (SELECT p_partkey AS page, i.i AS i, 100 + i.i * 1500 + (p_partkey * 31 + i.i * 177) % 900 AS x FROM part, range(0, 6) i(i))"


@query("x26_snapped_lines", f"""WITH {LINES}, r AS (SELECT p_partkey AS page, 150 + k.k * 1700 + (p_partkey * 17 + k.k * 91) % 700 AS x FROM part, range(0, 6) k(k)),
 b AS (SELECT ln.page, i, arg_min(r.x, abs(r.x - ln.x) * 100000 + r.x) AS near FROM ln JOIN r ON r.page = ln.page AND abs(r.x - ln.x) <= 300 AND i > 0 GROUP BY 1, 2)
 SELECT page, i, x, CASE WHEN i = 0 THEN x ELSE least(9990, i * 250 + max(coalesce(near, x) - i * 250) OVER (PARTITION BY page ORDER BY i)) END AS fitted FROM ln LEFT JOIN b USING (page, i)""")
def _(t):
    key = F.col("p_partkey")

    def spread(first: int, step: int, a: int, b: int, mod: int):
        at = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")), lambda k: F.lit(first) + k * step + (key * a + k * b) % mod)
        return t.part.select(key.alias("page"), F.posexplode(at).alias("i", "x")).withColumn("i", F.col("i").cast("long"))

    return Y.snapped(spread(100, 1500, 31, 177, 900), spread(150, 1700, 17, 91, 700), "page", 300, 250, 9990)


YS = "ys AS (SELECT p_partkey, list_sort(list_transform(list_filter(range(0, 14), lambda k: (k + p_partkey) % 5 <> 0 OR k = 0), lambda k: (k * (20 + p_size) + CASE WHEN (k * 3 + p_partkey) % 11 = 0 THEN -15 - p_size ELSE k * 7 % 3 END)::DOUBLE)) AS ys FROM part)"
MEDIAN = "(list_sort({0})[(len({0}) + 1) // 2] + list_sort({0})[len({0}) // 2 + 1]) / 2.0"


@query("x27_regular_lines", f"""WITH {YS}, g AS (SELECT p_partkey, ys, list_transform(range(1, len(ys)), lambda i: ys[i + 1] - ys[i]) AS gaps FROM ys), m AS (SELECT *, {MEDIAN.format('gaps')} AS m FROM g),
 f AS (SELECT *, list_filter(gaps, lambda x: x >= 0.6 * m AND x <= 1.4 * m) AS fit FROM m), p AS (SELECT p_partkey, ys, {MEDIAN.format('fit')} AS pitch FROM f),
 k AS (SELECT p_partkey, pitch, list_reduce(list_transform(ys, lambda y: [y]), lambda a, y: CASE WHEN y[1] - a[-1] >= 0.6 * pitch THEN list_concat(a, y) ELSE a END) AS kept FROM p)
 SELECT p_partkey, pitch, list_transform(list_reduce(list_transform(kept, lambda y: [y]), lambda a, y: list_concat(a, list_transform(range(1, greatest(1, round_even((y[1] - a[-1]) / pitch, 0)::BIGINT) + 1), lambda s: a[-1] + (y[1] - a[-1]) * s / greatest(1, round_even((y[1] - a[-1]) / pitch, 0)::BIGINT)))), lambda x: round(x, 6)) AS lines FROM k""")
def _(t):
    key, k_ = F.col("p_partkey"), F.sequence(F.lit(0), F.lit(13))
    shown = F.filter(k_, lambda k: ((k + key) % 5 != 0) | (k == 0))
    at = F.array_sort(F.transform(shown, lambda k: (k * (F.lit(20) + F.col("p_size")) + F.when((k * 3 + key) % 11 == 0, F.lit(-15) - F.col("p_size")).otherwise(k * 7 % 3)).cast("double")))
    pitched = spread(t.part.select("p_partkey", "p_size"), "p_partkey").select("p_partkey", at.alias("ys")).withColumn("pitch", Y.line_pitch(F.col("ys")))
    return pitched.select("p_partkey", "pitch", F.transform(Y.regular_lines(F.col("ys"), F.col("pitch")), lambda x: F.round(x, 6)).alias("lines"))


@query("x28_entry_rows", """WITH l AS (SELECT event_id // 20 AS page, event_id % 20 AS i, (event_id % 20 * 30)::DOUBLE AS y, CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0 END AS ink FROM events),
 s AS (SELECT page, min(i) FILTER (ink > 50) AS first, max(i) FILTER (ink > 50) AS last, max(i) AS stop, (max(y) - min(y)) / max(i) AS pitch FROM l GROUP BY 1),
 r AS (SELECT page, pitch, stop, unnest(range(first, last + 1, 3)) AS i FROM s WHERE first IS NOT NULL)
 SELECT r.page, greatest(0.0, a.y - 0.25 * pitch) AS top, b.y + 0.1 * pitch AS bottom FROM r JOIN l a ON a.page = r.page AND a.i = r.i JOIN l b ON b.page = r.page AND b.i = least(r.i + 3, stop) WHERE r.i < stop""")
def _(t):
    ink = F.when(F.col("event_type").isin("click", "view"), F.col("value")).otherwise(0.0)
    lines = t.events.select(F.floor(F.col("event_id") / 20).alias("page"), (F.col("event_id") % 20).alias("i"), (F.col("event_id") % 20 * 30).cast("double").alias("y"), ink.alias("ink"))
    return Y.entry_rows(lines, "page", 3, 50.0)


@query("x29_current_sets", "SELECT p_partkey, p_type AS side, upper(p_name) AS shown, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey DESC) > 2 AND p_type <> 'PROMO' AS archived FROM part")
def _(t):
    from ..operators.ordered import top

    side = F.col("p_type").alias("side")
    keep = top(t.part, ["p_type"], [F.desc("p_retailprice"), F.desc("p_partkey")], 2).select("p_partkey")
    old = t.part.where("p_type <> 'PROMO'").join(keep, "p_partkey", "left_anti").select("p_partkey", F.lit(True).alias("old"))
    return t.part.join(old, "p_partkey", "left").select("p_partkey", side, F.upper("p_name").alias("shown"), F.coalesce("old", F.lit(False)).alias("archived"))


FITS = """tl AS (SELECT p_partkey AS page, (60 + k.k * 190 + (p_partkey * 7 + k.k * 13) % 40)::DOUBLE AS x FROM part, range(0, 5) k(k)),
 ru AS (SELECT DISTINCT p_partkey AS page, (10 + 60 + k.k * 190 + (p_partkey * 7 + k.k * 13) % 40 + (p_partkey * 3 + k.k * 5) % 21)::DOUBLE AS x FROM part, range(0, 6) k(k) WHERE (p_partkey + k.k) % 4 <> 0),
 ri AS (SELECT page, x, coalesce(x - lag(x) OVER (PARTITION BY page ORDER BY x) >= 30, true) AS new FROM ru WHERE x > 20 AND x < 980), rd AS (SELECT page, x, sum(new::INTEGER) OVER (PARTITION BY page ORDER BY x) AS rule FROM ri),
 rs AS (SELECT page, list(r ORDER BY r) AS rules FROM (SELECT page, rule, avg(x) AS r FROM rd GROUP BY 1, 2) GROUP BY 1), ls AS (SELECT page, list(x ORDER BY x) AS lines FROM tl GROUP BY 1), b AS (SELECT * FROM ls JOIN rs USING (page)),
 m AS (SELECT page, lines, rules, i, k, j, l, (rules[l] - rules[j]) / (lines[k] - lines[i]) AS scale FROM b, range(1, 6) i(i), range(1, 6) k(k), range(1, 7) j(j), range(1, 7) l(l) WHERE i < k AND j < l AND l <= len(rules) AND lines[k] > lines[i]),
 s AS (SELECT *, rules[j] - scale * lines[i] AS shift FROM m WHERE scale BETWEEN 0.8 AND 1.25),
 n AS (SELECT *, list_filter(list_transform(lines, lambda x: list_min(list_transform(rules, lambda r: abs(scale * x + shift - r)))), lambda d: d <= 40) AS near FROM s WHERE scale * lines[1] + shift >= -20 AND scale * lines[5] + shift <= 1020),
 f AS (SELECT page, len(lines) AS n_lines, len(near) AS matched, scale, shift FROM n QUALIFY row_number() OVER (PARTITION BY page ORDER BY len(near) DESC, round(500 * abs(scale - 1) + coalesce(list_sum(near), 0), 9), i, k, j, l) = 1)"""


def fits(t):
    key = F.col("p_partkey")
    at = lambda k: F.lit(60) + k * 190 + (key * 7 + k * 13) % 40
    lines = t.part.select(key.alias("page"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), at)).alias("x"))
    shown = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda k: (key + k) % 4 != 0)
    rules = t.part.select(key.alias("page"), F.explode(F.transform(shown, lambda k: at(k) + 10 + (key * 3 + k * 5) % 21)).alias("x"))
    return Y.fitted_lines(lines, rules, "page", 1000.0)


@query("j23_fitted_lines", f"WITH {FITS} SELECT page, n_lines::INTEGER AS n_lines, matched::INTEGER AS matched, round(scale, 6) AS scale, round(shift, 6) AS shift FROM f WHERE matched >= 2")
def _(t):
    return fits(t).select("page", "n_lines", "matched", F.round("scale", 6).alias("scale"), F.round("shift", 6).alias("shift"))


@query("m03_fit_score", f"WITH {FITS} SELECT page, round(least(1.0, matched::DOUBLE / n_lines) * greatest(0.0, 1 - 2 * abs(ln(scale))), 3) AS score FROM f WHERE matched >= 2")
def _(t):
    from ..operators.geometry import fit_score

    return fits(t).select("page", fit_score(F.least(F.lit(1.0), F.col("matched") / F.col("n_lines")), F.col("scale")).alias("score"))


@query("x48_page_batch", "SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'odd' ELSE 'even' END AS parity, (SELECT max(p_partkey) FROM part WHERE p_partkey % 2 = event_id % 2) AS template, last_value(CASE WHEN event_id % 2 = 1 AND event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS row_share FROM events")
def _(t):
    """Pages of a batch take the newest template of their parity, and even pages the row shares of the odd page before."""
    from ..operators.ordered import fill_down

    newest = t.part.groupBy((F.col("p_partkey") % 2).alias("side")).agg(F.max("p_partkey").alias("template"))
    odd = F.col("event_id") % 2 == 1
    carried = fill_down(t.events, ["user_id"], [F.col("event_id")], F.col("value"), ~odd | (F.col("event_type") == "error"), "row_share")
    return carried.join(newest, F.col("event_id") % 2 == F.col("side"), "left").select("event_id", F.when(odd, "odd").otherwise("even").alias("parity"), "template", "row_share")


MOVE = "a * {0} + b2 + CASE WHEN len(list_filter(p2, lambda p: p.s <= {0})) = 0 THEN p2[1].off WHEN len(list_filter(p2, lambda p: p.s > {0})) = 0 THEN p2[-1].off ELSE list_filter(p2, lambda p: p.s <= {0})[-1].off + (list_filter(p2, lambda p: p.s > {0})[1].off - list_filter(p2, lambda p: p.s <= {0})[-1].off) * ({0} - list_filter(p2, lambda p: p.s <= {0})[-1].s) / (list_filter(p2, lambda p: p.s > {0})[1].s - list_filter(p2, lambda p: p.s <= {0})[-1].s) END"
OFF = "list_filter(list_transform(src, lambda s: {{'s': s, 'off': list_sort(list_transform(dst, lambda d: [abs(d - (a * s + {0})), d - (a * s + {0})]))[1][2]}}), lambda p: abs(p.off) <= 0.3 * ud)"


@query("j22_rows_between_pages", f"""WITH pg AS (SELECT p_partkey AS page, list_transform(list_filter(range(0, 20), lambda k: (k + p_partkey) % 7 <> 0), lambda k: (100 + k * (24 + p_size % 5) + (k * p_partkey) % 3)::DOUBLE) AS src,
  list_transform(list_filter(range(0, 20), lambda k: (k * 2 + p_partkey) % 5 <> 1), lambda k: (100 + p_partkey % 40 + k * (25 + p_size % 5) + (k + p_partkey) % 4)::DOUBLE) AS dst FROM part),
 u AS (SELECT *, list_aggregate(list_transform(range(1, len(src)), lambda i: src[i + 1] - src[i]), 'median') AS us FROM pg),
 v AS (SELECT *, list_aggregate(list_transform(range(1, len(dst)), lambda i: (dst[i + 1] - dst[i]) / greatest(1, round_even((dst[i + 1] - dst[i]) / us, 0))), 'median') AS ud FROM u),
 w AS (SELECT *, CASE WHEN ud / us BETWEEN 0.8 AND 1.25 THEN ud / us ELSE 1.0 END AS a FROM v), x AS (SELECT *, dst[1] - a * src[1] AS b FROM w), y AS (SELECT *, {OFF.format('b')} AS p1 FROM x),
 z AS (SELECT *, b + list_aggregate(list_transform(p1, lambda p: p.off), 'median') AS b2 FROM y WHERE len(p1) >= 3), q AS (SELECT *, {OFF.format('b2')} AS p2 FROM z), r AS (SELECT *, unnest(range(0, 3)) AS i FROM q WHERE len(p2) >= 3),
 e AS (SELECT *, (90 + i * 130)::DOUBLE AS y0, (90 + i * 130 + 70)::DOUBLE AS y1 FROM r), m AS (SELECT page, {MOVE.format('y0')} AS t0, {MOVE.format('y1')} AS t1 FROM e)
 SELECT page, round(t0, 6) AS top, round(t0 + greatest(1.0, t1 - t0), 6) AS bottom FROM m""")
def _(t):
    key, size, all_ = F.col("p_partkey"), F.col("p_size") % 5, F.sequence(F.lit(0), F.lit(19))
    src = F.transform(F.filter(all_, lambda k: (k + key) % 7 != 0), lambda k: (F.lit(100) + k * (F.lit(24) + size) + (k * key) % 3).cast("double"))
    dst = F.transform(F.filter(all_, lambda k: (k * 2 + key) % 5 != 1), lambda k: (F.lit(100) + key % 40 + k * (F.lit(25) + size) + (k + key) % 4).cast("double"))
    ours, theirs = (t.part.select(key.alias("page"), F.explode(x).alias("y")) for x in (src, dst))
    bands = t.part.select(key.alias("page"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("page", "i", (F.lit(90) + F.col("i") * 130).cast("double").alias("top"), (F.lit(160) + F.col("i") * 130).cast("double").alias("bottom"))
    mapped = Y.rows_between_pages(ours, theirs, bands, "page")
    return mapped.select("page", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))
