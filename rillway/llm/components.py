"""Connected components of links, by alternating stars: every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """id, component for each end of links (a, b): the smallest id reachable. Ids without links are not returned.

    Large star: each larger neighbour of a node moves to the node's smallest neighbour. Small star: so does each smaller
    one. The number of rounds grows with the logarithm of the longest path; each round is written to the shared folder.
    """
    edges = saved(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("hi", "lo"))
        least = both.groupBy(F.col("lo").alias("node")).agg(F.min("hi").alias("near"))
        least = least.select("node", F.least("node", "near").alias("least"))
        moved = edges.join(least, edges["lo"] == least["node"]).select("hi", "least")
        large = moved.where("hi <> least").select(F.col("least").alias("lo"), "hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        joined = large.join(least, "hi")
        small = joined.where("lo <> least").select(F.col("least").alias("lo"), F.col("lo").alias("hi"))
        edges = saved(small.union(least.select(F.col("least").alias("lo"), "hi")).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    members = edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return members.union(edges.select(F.col("lo").alias("id"), F.col("lo"))).distinct()
