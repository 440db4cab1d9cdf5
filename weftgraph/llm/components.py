"""Connected components of an edge table by alternating large and small stars, without gathering a node's edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialise


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a long, b long); component is the smallest node reachable.

    Each round is two aggregations and two joins by node and is written to the shared folder; rounds grow with the logarithm of the
    number of nodes. Loops and repeated edges don't matter. No edges give no rows.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        small = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")
        now = materialise(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), name)
        got = now.agg(F.count("*"), F.coalesce(F.sum(F.expr("try_cast(xxhash64(u, v) as decimal(38,0))")), F.lit(0))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
