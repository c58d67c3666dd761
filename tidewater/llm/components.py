"""Connected components of a graph too large for one machine, by hooking and contraction.

Each round lets every node hook to the smallest of itself and its neighbours, follows the hooks to
their roots and contracts the graph to the roots.  A node with a neighbour either hooks or is hooked
to, so the nodes that still have edges at least halve in each round.  Nothing but a row count reaches
the driver.  The label of a component is its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, saved_and_counted


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, parent) with parent <= node, followed to the parent that is its own parent."""
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        longer, moved = saved_and_counted(hooks.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved")), "hooks", F.col("moved"))
        hooks = longer.select("node", "parent")
        if not moved:
            return hooks


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs, in any order and repeated at will, to (node, component) for each node that has an edge.

    Self-loops count as nodes.  An empty input gives an empty result.  Nulls aren't allowed.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("parent"))
        hooks = _roots(saved(hooks, "hooks"))
        labels = hooks if labels is None else saved(labels.join(hooks.select(F.col("node").alias("parent"), F.col("parent").alias("root")), "parent", "left").select("node", F.coalesce("root", "parent").alias("parent")), "labels")
        to = lambda end: hooks.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_root"))
        edges = edges.join(to("a"), "a").join(to("b"), "b").where("a_root != b_root")
        edges, left = saved_and_counted(edges.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges", F.lit(True))
        if not left:
            return labels.select("node", F.col("parent").alias("component"))
