"""Connected components by contraction: hook every node on its smallest neighbour, shorten, relabel, repeat."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.tables import cut


def components(links: DataFrame) -> DataFrame:
    """Undirected links (a, b) -> (node, component) for every node of a link between different nodes.

    The component is its smallest node.  Each round hooks the larger end of
    every link on the least node it is linked with, follows these hooks to
    their roots by pointer jumping, and keeps only links between different
    roots.  Rounds are written tables; nothing is gathered in a task, and hot
    roots are plain join keys that adaptive execution splits.
    """
    edges, seen = cut(links.where("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    layers = []
    while seen["n"]:
        hooks, _ = cut(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        while True:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped, state = cut(
                hooks.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"),
                                                         F.col("top").isNotNull().alias("moved")),
                F.sum(F.col("moved").cast("long")).alias("moved"))
            hooks = jumped.select("node", "root")
            if not state["moved"]:
                break
        layers.append(hooks)
        edges = named(named(edges, hooks, "hi"), hooks, "lo")
        edges, seen = cut(edges.where("hi <> lo").select(
            F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
    nodes = links.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    out = nodes.select("node", F.col("node").alias("component"))
    for hooks in layers:
        out = named(out, hooks, "component")
    return out


def named(frame: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """Replace a column's nodes by their roots."""
    roots = hooks.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return frame.join(roots, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")
