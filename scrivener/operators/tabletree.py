"""Comparing two versions of a table by a tree of digests: only leaves that differ are read again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, DoubleType, FloatType, IntegerType, NumericType, StringType, StructField, StructType, TimestampNTZType, TimestampType

#: Children of a node, and levels below the root.
FANOUT, LEVELS = 16, 2
#: Parts of a leaf, each with a digest of its own: rows of parts that are equal are passed over.
PARTS = 256
_DIGEST = ("n", "d0", "d1", "d2", "d3")
_HASHED = (NumericType, StringType, BinaryType, BooleanType, DateType, TimestampType, TimestampNTZType)


@dataclass(frozen=True)
class TableTree:
    """A table written with its rows in folders by leaf, and the digest of each part of a leaf.

    A row's leaf and part come from a hash of its keys, so a key is in one part in every version. A
    digest is the number of rows and the sums of the four quarters of their 128-bit hashes: it
    counts repeated rows, and does not depend on their order.
    """

    path: str
    keys: tuple[str, ...]
    levels: int = LEVELS

    def leaves(self) -> int:
        return FANOUT**self.levels

    def leaf(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.leaves())).cast("int")

    def part(self) -> Column:
        return F.pmod(F.shiftright(F.xxhash64(*self.keys), 32), F.lit(PARTS)).cast("int")

    def write(self, df: DataFrame) -> TableTree:
        """Rows once through a shuffle by leaf, then a digest table of one row a part."""
        df.withColumn("_leaf", self.leaf()).repartition("_leaf").write.partitionBy("_leaf").parquet(f"{self.path}/rows")
        rows = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("_leaf", IntegerType())])).parquet(f"{self.path}/rows")
        halves = rows.select("_leaf", self.part().alias("_part"), *[h.alias(c) for h, c in zip(row_hashes(df.schema), ("_high", "_low"))])
        # quarters of 32 bits add up in a long
        quarters = [q for c in ("_high", "_low") for q in (F.shiftrightunsigned(c, 32), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))]
        halves.groupBy("_leaf", "_part").agg(F.count("*").alias("n"), *[F.sum(q).alias(c) for q, c in zip(quarters, _DIGEST[1:])]).write.parquet(f"{self.path}/digests")
        return self

    def digests(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/digests")

    def rows(self, spark: SparkSession, leaves: Sequence[int] | None = None) -> DataFrame:
        """The rows, or only the folders of some leaves."""
        found = spark.read.parquet(f"{self.path}/rows")  # leaves are folders, so others are not opened
        return (found if leaves is None else found.where(F.col("_leaf").isin(list(leaves)))).drop("_leaf")

    def level(self, spark: SparkSession, depth: int) -> DataFrame:
        """``node, n, high, low`` of the nodes at a depth (0: the root), added up from the leaves."""
        node = F.floor(F.col("_leaf") / FANOUT ** (self.levels - depth)).cast("int").alias("node")
        return self.digests(spark).groupBy(node).agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in _DIGEST])


def row_text(columns: Sequence[str]) -> Column:
    """A row as text, columns by name, each with its length, so that no two rows share one; nulls differ from every value."""
    said = [F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(columns)]
    return F.concat_ws(",", *said)


def row_hashes(schema: StructType) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row, columns by name, each after whether it is null; taken from the values themselves, which costs far less than their texts.

    Signs of zeros count, as in :func:`row_text`. Columns of other types than numbers, texts, bytes and times are taken as text.
    """
    said: list[Column] = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        said += [c.isNull(), c if isinstance(f.dataType, _HASHED) else c.cast("string")]
        if isinstance(f.dataType, (DoubleType, FloatType)):
            said.append(F.when(c == 0, c.cast("string").startswith("-")))  # hashes take -0.0 for 0.0
    return F.xxhash64(F.lit("high"), *said), F.xxhash64(F.lit("low"), *said)


def _differing(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """``on`` of the digests that differ or are in one table only."""
    both = a.alias("a").join(b.alias("b"), list(on), "full").where(~F.struct(*[F.col(f"a.{c}") for c in _DIGEST]).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in _DIGEST])))
    return both.select(*on)


def differing_leaves(spark: SparkSession, old: TableTree, new: TableTree) -> list[int]:
    """Numbers of the leaves that differ, found from the root down among children of nodes that differ.

    The driver gets node numbers, bounded by the leaves of the tree.
    """
    if (old.keys, old.levels) != (new.keys, new.levels):
        raise ValueError("trees of unlike keys or depth")
    open_ = [0]
    for depth in range(old.levels + 1):
        a, b = (t.level(spark, depth).where(F.col("node").isin(open_)) for t in (old, new))
        nodes = sorted(r["node"] for r in _differing(a, b, ["node"]).collect())
        if depth == old.levels or not nodes:
            return nodes
        open_ = [n * FANOUT + k for n in nodes for k in range(FANOUT)]
    return []


def compare(spark: SparkSession, old: TableTree, new: TableTree) -> DataFrame:
    """``keys, kind, n``: keys whose rows are ``missing`` in the new version, ``extra`` in it, or ``changed``, with the number of rows that differ.

    Rows are compared as wholes with their multiplicity; nulls are equal to nulls. Only rows of differing leaves are read, and of those only rows of differing parts compared.
    """
    leaves, keys = differing_leaves(spark, old, new), list(old.keys)
    where = F.col("_leaf").isin(leaves)
    # at most PARTS rows a leaf, whatever the tables hold
    parts = F.broadcast(_differing(old.digests(spark).where(where), new.digests(spark).where(where), ["_leaf", "_part"]))
    a, b = (t.rows(spark, leaves).withColumns({"_leaf": t.leaf(), "_part": t.part()}).join(parts, ["_leaf", "_part"], "left_semi").drop("_leaf", "_part") for t in (old, new))
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("tables of unlike columns")
    text = row_text(a.columns)
    sided = a.select(*keys, text.alias("_t"), F.lit(1).alias("_d")).union(b.select(*keys, text.alias("_t"), F.lit(-1).alias("_d")))
    rows = sided.groupBy(*keys, "_t").agg(F.sum("_d").alias("_d"), F.count_if(F.col("_d") > 0).alias("_a"), F.count_if(F.col("_d") < 0).alias("_b"))
    by_key = rows.groupBy(*keys).agg(F.sum(F.greatest("_d", F.lit(0))).alias("_gone"), F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias("_come"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_gone + _come > 0")
    kind = F.when(F.col("_b") == 0, "missing").when(F.col("_a") == 0, "extra").otherwise("changed")
    return by_key.select(*keys, kind.alias("kind"), F.greatest("_gone", "_come").alias("n"))
