"""Connected components by joins: labels spread along edges and are shortened by pointer jumping.

Each round every node takes the smallest root seen by itself and its neighbours, hangs its old root below it,
and jumps to its root's root. Rounds are written to the shared folder; the number of rounds grows with the
logarithm of the longest path. Only a count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtide.session import cut_lineage


def components(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``node`` and ``value``, the smallest value in the node's component, for every node that has an edge.
    ``edges``: a, b, either direction, each pair once or more; ``values``: node, value."""
    both = cut_lineage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        seen = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "root")
        low = seen.groupBy("node").agg(F.min("root").alias("low"))
        near = labels.join(low, "node").select("node", "root", F.least("low", "root").alias("low"))
        # an old root takes the smallest label found by any node below it
        hung = near.where("low < root").groupBy(F.col("root").alias("node")).agg(F.min("low").alias("under"))
        moved = near.join(hung, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("low", F.coalesce("under", "low")).alias("root")
        )
        moved = cut_lineage(moved)
        up = moved.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = moved.join(up, "root", "left").select(
            "node", "old", F.least("root", F.coalesce("above", "root")).alias("root")
        )
        jumped = cut_lineage(jumped)
        labels = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            break
    least = labels.join(values, "node").groupBy("root").agg(F.min("value").alias("value"))
    return labels.join(least, "root").select("node", "value")
