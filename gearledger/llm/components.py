"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearledger.session import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Alternating large-star and small-star steps: each node's neighbours are hung on the smallest of them, until every node
    hangs on the smallest node of its component; edges that are such stars already take no round. Both steps are a combinable minimum and one join, so the many neighbours of a hub
    are spread over tasks. The edges of each round are written, so a lost executor repeats one step, and deleted when the next are; the
    last ones belong to ``scratch`` where it is given. Edges with a null end, and of a node with itself, count for nothing.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.cut(edges)
    for _ in range(max_rounds):
        # Stars: who hangs on another node hangs on no second one, and none hangs on them.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
        if not ends.filter((F.col("up") > 1) | (F.col("up") > 0) & (F.col("n") > F.col("up"))).count():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: a node's larger neighbours go to the smallest node around it.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.cut(large)
        # Small star: a node and its smaller neighbours go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        later = scratch.cut(small)
        scratch.drop(edges, large)
        edges = later
        scratch.tidy()
    else:
        raise RuntimeError("components did not settle")
    tree = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tree.unionByName(tree.select(F.col("component").alias("node"), "component").distinct())
