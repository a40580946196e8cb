"""Connected components by alternating neighbour minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.runtime import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(a, b); root is the component's least node.

    Each round, every node takes the least root among itself and its
    neighbours, then follows its root once. Both are aggregates with map-side
    partials, so a hub with any number of links is no hot task; the rounds grow
    with the logarithm of the diameter. Lineage is cut in each round.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    root = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    held = root
    while True:
        seen = both.join(root.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = root.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = root.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = cut(step.join(jump, "root", "left").select("node", "was", F.coalesce(F.least("root", "far"), "root").alias("root")))
        discard(held)
        root, held = step.select("node", "root"), step
        if step.where("root <> was").isEmpty():
            out = cut(root)
            discard(both, held)
            return out
