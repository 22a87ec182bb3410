"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm._shared import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Each round's edges are written to the shared folder, so the lineage stays short. The rounds end
    when no edge changes, a number that grows with the logarithm of the longest chain.
    """
    now = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u <> v").distinct()
    now = written(now, "star")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Written, so that the join below has two plain shuffles and a node of many edges is split.
        least = written(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m")), "least")
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        own = least.select("v", F.col("m").alias("u"))
        small = large.join(least, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(own)
        now = written(small.filter("u <> v").distinct(), "star")
    nodes = now.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return nodes.unionByName(roots.join(nodes.select("node"), "node", "left_anti"))
