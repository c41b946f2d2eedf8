"""Connected components over an edge table by alternating large and small stars.

Every round is two aggregations with map-side combine and two equi joins on
the edge table, which shrinks to one star per component. Labels stay in Spark;
only a count and a checksum reach the driver to see that a round changed nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``; root is its component's smallest node.

    Self edges and null ends are ignored, repeats don't matter, an empty table
    gives an empty table. Nodes need only an order.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    state = None
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        mins = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(mins, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = cut(small.union(mins.select("hi", "m")).distinct())
        drop_cut(now)
        now, before = after, state
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo"), F.col("lo")).distinct()
    )
