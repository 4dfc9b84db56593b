"""Connected components by contraction: every round is a few joins, each written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.session import written


def _pointers(edges: DataFrame) -> DataFrame:
    """(node, parent): each node's least neighbour, or itself, followed to the end of the chain."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    p = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")), "pointers")
    while True:
        up = p.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        top = p.select(F.col("node").alias("above"), F.col("parent").alias("top"))
        moved = p.join(up, "parent").join(top, "above").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved"))
        q = written(moved, "pointers")
        p = q.drop("moved")
        if q.filter("moved").isEmpty():
            return p


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node.

    Each round points every node to its least neighbour, follows the pointers, and
    replaces nodes by their roots; edges inside a root go. Nodes with an edge left at
    least halve each round. Nothing is gathered on the driver; joins on a node with many
    edges are between written tables, so Spark can split them. Loops and repeated edges
    do no harm, and a null end drops its edge; no edges give no rows.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        p = _pointers(left)
        if labels is None:
            labels = p.withColumnRenamed("parent", "component")
        else:
            to = p.select(F.col("node").alias("component"), "parent")
            labels = written(labels.join(to, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        pa, pb = p.select(F.col("node").alias("a"), F.col("parent").alias("pa")), p.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        between = left.join(pa, "a").join(pb, "b").filter(F.col("pa") != F.col("pb"))
        left = written(between.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels
