"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.sources.storage import settle


def components(edges: DataFrame) -> DataFrame:
    """node and root (least node reachable) of every node in edges (a, b).

    Every round points each node at the least root among its neighbours and itself, then
    follows pointers once; the edges are re-hung on the roots and those inside a root go.
    Rounds end when no edge joins different roots, about the logarithm of the diameter.
    """
    links = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = settle(nodes.withColumn("root", F.col("node")), "roots")
    while not links.isEmpty():
        # a is the larger root of an edge, so pointers only ever go down.
        hook = links.groupBy("a").agg(F.min("b").alias("to"))
        jump = hook.join(hook.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left").select(
            "a", F.coalesce("next", "to").alias("to")
        )
        jump = settle(jump, "hooks")
        roots = settle(
            roots.join(jump, roots.root == jump.a, "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
        )
        left = links.join(jump, "a").select(F.col("to").alias("a"), "b")
        down = jump.select(F.col("a").alias("b"), F.col("to").alias("c"))
        moved = left.join(down, "b", "left").select("a", F.coalesce("c", "b").alias("b")).where("a <> b")
        links = settle(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return roots
