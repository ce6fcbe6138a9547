"""Connected components by joins and aggregations: hooking and shortcutting (FastSV), no group is ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.plans.shared import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round is O(edges) and rounds are logarithmic in the nodes; each is written to the shared folder. No edges: no rows.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u != v").distinct()
    both = materialize(both, "edges")
    parent = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("p"))
    parent = materialize(parent, "parents")
    before = None
    while True:
        now = parent.agg(F.sum(F.xxhash64("node", "p") % 1_000_003), F.count("*")).first()
        if now == before:
            break
        before = now
        up = parent.select(F.col("node").alias("q"), F.col("p").alias("g"))
        grand = parent.join(up, F.col("p") == F.col("q")).select("node", "p", "g")
        near = both.join(grand.select(F.col("node").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        near = near.join(parent, F.col("u") == F.col("node")).select("node", "p", "m")
        moves = near.select("node", "m").union(near.select("p", "m")).union(grand.select("node", "g"))
        parent = materialize(moves.groupBy("node").agg(F.min("m").alias("p")), "parents")
    return parent.select("node", F.col("p").alias("component"))
