"""Connected components by contraction and pointer doubling, all in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node and component (the smallest node reachable) of every node of ``edges`` (a, b; long).

    In each round every node points to the smallest of itself and its neighbours. Pointers are doubled (each node
    takes over where its target points) until all point to a root, the nodes' labels follow, and the edges are carried
    over to the roots. A tree of pointers of depth d takes log2(d) doublings and is one node afterwards; each node
    that has a neighbour left is hung up or hung on, so the nodes at least halve from round to round and a path of n
    nodes takes about log2(n) steps in any order. Each step is a job of its own that reads and writes tables, so no
    plan grows with the rounds. No node's neighbours are ever gathered. Loops and repeated edges are harmless.
    """
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = scratch.save(ordered(edges), f"{name}-edges", few=True)
    label: DataFrame | None = None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        up, moving = scratch.save(up, f"{name}-up", few=True), True
        while moving:
            # only nodes whose target isn't a root move on; roots stand in the table too
            top = up.where("node <> up").select(F.col("node").alias("up"), F.col("up").alias("top"))
            new = scratch.save(up.join(top, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), f"{name}-up", few=True)
            moving, up = not new.where("moved").isEmpty(), new.drop("moved")
        if label is None:
            label = up.withColumnRenamed("up", "component")
        else:
            root = up.select(F.col("node").alias("component"), F.col("up").alias("root"))
            label = label.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            label = scratch.save(label, f"{name}-label", few=True)
        moved = e.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").select("x", "b")
        moved = moved.join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        e = scratch.save(ordered(moved), f"{name}-edges", few=True)
    if label is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = scratch.save(label, f"{name}-result", few=True)
    scratch.drop(f"{name}-edges", f"{name}-up", f"{name}-label")
    return out
