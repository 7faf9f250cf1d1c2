"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node that an edge ``(a, b)`` of longs names.

    ``root`` is the smallest node reachable. Each round hooks every root that has a
    smaller neighbour to its smallest one, follows the hooks by pointer jumping and
    contracts the edges, so at least half of the roots with edges vanish a round and a
    chain of n nodes takes O(log n) rounds. All steps are joins and min-aggregates (with
    map-side combine) on narrow rows; nothing but edge counts reaches the driver. Self
    loops and repeated edges are harmless; no edges give no rows; edges with a null end
    are ignored.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = staged(nodes.select("node", F.col("node").alias("root")), "labels")
    links = staged(links.where("a < b").distinct(), "links")
    while not links.isEmpty():
        hooks = staged(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")
        while True:  # pointer jumping: each pass halves the depth of the hook forest
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = hooks.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
            jumped = staged(jumped, "hooks")
            hooks = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        labels = staged(
            labels.join(hooks.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels"
        )
        up_a, up_b = (hooks.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        moved = links.join(up_a, "a", "left").join(up_b, "b", "left").select(F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b"))
        links = staged(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels
