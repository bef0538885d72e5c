"""Distributed connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import discard, stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(a, b)`; component is the smallest node reachable.

    Each round every node points at its smallest neighbour, pointers are followed twice, and the
    edges are redrawn between the nodes pointed at, until none is left: the number of rounds grows
    with the logarithm of the longest path. Rounds are joins and partial aggregates over tables in
    the shared folder, so a node with very many edges is never gathered in one task. Edges with a
    null end and loops are dropped.
    """
    ends = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    nodes = None
    edges = stored(ends(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")))
        points = near
        for _ in range(2):
            step = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            points = points.join(step, "to").select("node", F.col("next").alias("to"))
        points = stored(points)
        last = nodes
        if nodes is None:
            nodes = points.withColumnRenamed("to", "component")
            nodes.stored_at = points.stored_at
        else:
            moved = points.select(F.col("node").alias("component"), "to")
            nodes = stored(nodes.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        redrawn = edges
        for end in ("a", "b"):
            redrawn = redrawn.join(points.select(F.col("node").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        redrawn = stored(ends(redrawn))
        discard(near, edges, *([points, last] if last is not None else []))
        edges = redrawn
    return nodes if nodes is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
