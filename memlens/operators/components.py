"""Connected components by alternating star contraction; every round is two aggregates and joins, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each node's larger neighbours to the smallest of {node, neighbours}; small star: link the
    node and its smaller neighbours to it.  Sums of this kind combine on the map side; a hub's neighbours stay rows."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges(u, v)``; the component is its smallest node.

    Nodes are longs.  Rounds end when every node points straight at a root; each is checkpointed to the shared folder.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        stars = now.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        roots = stars.select(F.col("u").alias("v"))
        if stars.where("n > 1").isEmpty() and now.join(roots, "v", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
        now = cut(_star(_star(now, True), False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
