"""Pairs of similar texts from equi-joins: on what is left of short texts without the letters that may differ, of longer ones on the rarest letters that both must share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept

#: A signature whose two sides would make more pairs than this is split by one more letter.
MANY_PAIRS = 20_000
#: Short texts are those where taking out the letters that may differ (at most three) leaves no more rests than this.
MOST_RESTS = 300


def numbered_letters(text: Column) -> Column:
    """Each letter of a text with how often it stood before: ABBA gives A0, B0, B1, A1. Common entries are common letters with their number."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.element_at(F.transform(F.array(letters), lambda cs: F.transform(cs, lambda c, i: F.concat(c, F.size(F.filter(F.slice(cs, 1, i), lambda x: x == c)).cast("string")))), 1)


def _by_rarity(texts: DataFrame, keys: Sequence[str], counts: DataFrame) -> DataFrame:
    """``keys, text, size, letters``: the numbered letters of each text as hashes, rarest first (ties by hash, so in one order everywhere)."""
    spread = texts.select(*keys, "text", F.explode(numbered_letters(F.col("text"))).alias("_l")).withColumn("_l", F.xxhash64("_l"))
    ranked = spread.join(counts, "_l", "left").groupBy(*keys, "text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_l").alias("l")))).alias("_ls"))
    return ranked.select(*keys, "text", F.size("_ls").alias("size"), F.transform("_ls", lambda x: x["l"]).alias("letters"))


def _shared(a: Column, b: Column, cutoff: float) -> Column:
    """Letters that texts of two sizes have in common at least, in the same order."""
    return F.ceil(cutoff * (a + b) / 2 - 1e-9).cast("int")


def _sizes(partner: tuple[Column, Column, int, int]) -> Column:
    """Sizes from the least to the greatest of a partner, of those between the two that texts of its side have."""
    low, high, least, most = partner
    return F.filter(F.sequence(F.greatest(low, F.lit(1)).cast("int"), F.greatest(high, F.lit(1)).cast("int")), lambda n: n.between(least, most))


def _ends(texts: DataFrame) -> tuple[int, int]:
    """Least and greatest size of the texts; of none, two that no size lies between."""
    found = texts.agg(F.min(F.length("text")), F.max(F.length("text"))).first()
    return (1, 0) if found[0] is None else (found[0], found[1])


def _reach(cutoff: float) -> tuple[Column, Column]:
    """Least and greatest size of a partner that may come to ``cutoff`` at all: the shorter text lies whole in the longer one."""
    size = F.col("size")
    return F.ceil(size * cutoff / (2 - cutoff) - 1e-9), F.floor(size * (2 - cutoff) / cutoff + 1e-9)


def _short(a: Column, b: Column, cutoff: float) -> Column:
    """Whether texts of two sizes are compared by their rests."""
    few = lambda n, d: (d == 0) | (d == 1) & (n <= MOST_RESTS) | (d == 2) & (n * (n - 1) / 2 <= MOST_RESTS) | (d == 3) & (n * (n - 1) * (n - 2) / 6 <= MOST_RESTS)
    o = _shared(a, b, cutoff)
    return (o >= 1) & few(a, a - o) & few(b, b - o)


def _rests(text: Column, n: int) -> Column:
    """Distinct hashes of what is left of a text when ``n`` letters are taken out, each next one at or after the place of the last."""
    if n == 0:
        return F.array(F.xxhash64(text))
    without = lambda x, i: F.concat(F.substring(x["t"], F.lit(1), i - 1), F.substring(x["t"], i + 1, F.length(x["t"])))
    places = lambda x: F.when(x["at"] <= F.length(x["t"]), F.sequence(x["at"], F.length(x["t"]))).otherwise(F.array().cast("array<int>"))
    out = F.array(F.struct(text.alias("t"), F.lit(1).alias("at")))
    for _ in range(n - 1):
        out = F.flatten(F.transform(out, lambda x: F.transform(places(x), lambda i: F.struct(without(x, i).alias("t"), i.alias("at")))))
    return F.array_distinct(F.flatten(F.transform(out, lambda x: F.transform(places(x), lambda i: F.xxhash64(without(x, i))))))


def _rest_rows(texts: DataFrame, keys: Sequence[str], partner: tuple[Column, Column, int, int], cutoff: float, name: str) -> DataFrame:
    """Rows ``keys, rest, o, name``: the hash of a text without as many letters as it may have for itself, for each such number among partners that are short, and the letters left."""
    size = F.col("size")
    out = F.array_distinct(F.transform(F.filter(_sizes(partner), lambda n: _short(size, n, cutoff)), lambda n: size - _shared(size, n, cutoff)))
    # texts are few bytes for much work: dealt out over all partitions
    spread = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text")
    dealt = spread.withColumn("size", F.length("text")).select(*keys, "text", "size", F.explode(out).alias("_d"))
    rests = F.when(F.col("_d") == 0, _rests(F.col("text"), 0))
    for n in (1, 2, 3):
        rests = rests.when(F.col("_d") == n, _rests(F.col("text"), n))
    return dealt.select(*keys, F.explode(rests).alias("rest"), (size - F.col("_d")).alias("o"), F.col("text").alias(name))


def _rest_pairs(ls: DataFrame, rs: DataFrame, keys: Sequence[str], a: str, b: str, cutoff: float, partner: tuple[Column, Column, int, int], back: tuple[Column, Column, int, int]) -> DataFrame:
    """Pairs ``keys, a, b`` of short texts that have a common rest of the length they must share (equal hashes of others only make a pair more)."""
    # estimates do not know how many rests a text has: rows are never sent whole to all tasks
    met = _rest_rows(ls, keys, partner, cutoff, a).join(_rest_rows(rs, keys, back, cutoff, b).hint("merge"), [*keys, "rest", "o"]).withColumn("size", F.length(a))
    fits = (F.col("o") == _shared(F.length(a), F.length(b), cutoff)) & _short(F.length(a), F.length(b), cutoff)
    return met.where(fits & F.length(b).between(partner[0], partner[1])).select(*keys, a, b)


def _rows(ranked: DataFrame, keys: Sequence[str], own: str, other: str, partner: tuple[Column, Column, int, int], cutoff: float) -> DataFrame:
    """Signature rows ``keys, own, other, sig, x, y, text, more``: each pair of letters among those that a partner of size ``other`` must share two of."""
    sized = ranked.withColumn(own, F.col("size")).withColumn(other, F.explode(_sizes(partner))).where(~_short(F.col(own), F.col(other), cutoff))
    shared = _shared(F.col(own), F.col(other), cutoff)
    fit = sized.withColumn("_o", shared).where((F.col("_o") <= F.col(own)) & (F.col("_o") <= F.col(other)))
    # of o shared letters two lie among the first size - o + 2 of each text, three among the first size - o + 3
    first = fit.withColumn("_p", F.slice("letters", F.lit(1), F.least(F.col(own) - F.col("_o") + 2, F.col(own))))
    pairs = F.flatten(F.transform("_p", lambda x, i: F.transform(F.slice("_p", i + 2, F.greatest(F.size("_p") - i - 1, F.lit(0))), lambda y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")))))
    single = F.transform("_p", lambda x: F.struct(x.alias("x"), x.alias("y")))
    more = F.when(F.col("_o") >= 3, F.slice("letters", F.lit(1), F.least(F.col(own) - F.col("_o") + 3, F.col(own))))
    rows = first.withColumn("_s", F.explode(F.when(F.col("_o") >= 2, pairs).otherwise(single)))
    return rows.select(*keys, own, other, F.col("_s.x").alias("x"), F.col("_s.y").alias("y"), "text", more.alias("more"))


def similar_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, cutoff: float, most_apart: tuple[Column, Column] | None = None, *, many: int = MANY_PAIRS) -> DataFrame:
    """Distinct ``keys, a, b`` holding every pair of texts of a key that could have a matching-blocks similarity of ``cutoff`` or more.

    Matching blocks hold no more letters than the texts have in common, so a pair at
    ``cutoff`` has o = ceil(cutoff * (both sizes) / 2) numbered letters in common. Blocks keep
    their order, so o letters are left of both texts alike when the others are taken out: where
    that leaves few rests (:data:`MOST_RESTS`), pairs are joined on them. Of longer texts, sorted by
    rarity, two of the common letters lie among the first size - o + 2 of either text: those pairs of
    letters are the signatures, joined for equality together with both sizes. ``most_apart``
    bounds the size of a partner in terms of ``size`` (columns: least and greatest size of the
    right text of a left one); without it all sizes that ``cutoff`` allows meet. A signature with over ``many`` pairs is split by a third
    common letter. Null texts pair with nothing, empty ones neither.
    """
    ls, rs = (kept(df.select(*keys, F.col(c).alias("text")).where(F.length(c) > 0).distinct(), "texts") for df, c in ((left, a), (right, b)))
    # sizes of left texts that may meet a right one: a superset, cut down by the join
    back = (*_reach(cutoff), *_ends(ls))
    partner = (*(most_apart or _reach(cutoff)), *_ends(rs))
    close = _rest_pairs(ls, rs, keys, a, b, cutoff, partner, back)
    ls, rs = (df.withColumn("size", F.length("text")).where(F.exists(_sizes(p), lambda n: ~_short(F.col("size"), n, cutoff))).drop("size") for df, p in ((ls, partner), (rs, back)))
    counts = rs.select(F.explode(numbered_letters(F.col("text"))).alias("_l")).groupBy(F.xxhash64("_l").alias("_l")).agg(F.count("*").alias("_n"))
    counts = kept(counts, "letters")
    lr = _rows(_by_rarity(ls, keys, counts), keys, "_m", "_n", partner, cutoff)
    lr = kept(lr, "signatures")
    rr = _rows(_by_rarity(rs, keys, counts), keys, "_n", "_m", back, cutoff)
    rr = kept(rr, "signatures")
    on = [*keys, "_m", "_n", "x", "y"]
    sizes = lr.groupBy(*on).agg(F.count("*").alias("_l")).join(rr.groupBy(*on).agg(F.count("*").alias("_r")), on)
    hot = sizes.where(F.col("_l") * F.col("_r") > many).select(*on, F.lit(True).alias("_hot"))

    def split(rows: DataFrame, name: str) -> DataFrame:
        marked = rows.join(hot, on, "left")
        third = F.filter("more", lambda z: (z != F.col("x")) & (z != F.col("y")))
        return marked.select(*on, F.explode_outer(F.when(F.col("_hot") & F.col("more").isNotNull(), third)).alias("z"), F.col("text").alias(name)).withColumn("z", F.coalesce("z", F.lit(0)))

    return split(lr, a).join(split(rr, b), [*on, "z"]).select(*keys, a, b).union(close).distinct()
