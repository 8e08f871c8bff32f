"""Connected components of an undirected graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexoria.plans.runtime import discard, publish


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; the component is the smallest node in it.

    Labels spread along links and then jump along labels, so the rounds grow with the logarithm of
    the longest path. Minima are combined before each shuffle, so a node with very many links does
    no harm. Links with a null end and links to itself are ignored, repeated ones count once. Ends
    may be of any type with an order.
    """
    e = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = publish(e.union(e.select("b", "a")).distinct(), "links")
    label = publish(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "label")
    while True:
        spread = (
            e.join(label, e["a"] == label["node"]).groupBy(F.col("b").alias("_n")).agg(F.min("component").alias("_c"))
        )
        near = label.join(spread, label["node"] == F.col("_n"), "left").select(
            "node", F.col("component").alias("_old"), F.least("component", "_c").alias("component")
        )
        near = publish(near, "near")
        up = near.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        jumped = near.join(up, near["component"] == F.col("_n"), "left").select(
            "node", "_old", F.least("component", "_c").alias("component")
        )
        new = publish(jumped, "label")
        moved = not new.where(F.col("component") != F.col("_old")).isEmpty()
        discard(near)
        discard(label)
        label = new
        if not moved:
            return label.select("node", "component")
