"""Connected components of an edge table, by alternating large and small stars.

Each round is a fixed number of joins and minima over the edges; the number of rounds grows with the
logarithm of the longest path. Rounds are written to scratch tables, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def star_components(edges: DataFrame, scratch: Scratch, label: str = "cc", *, max_rounds: int = 60) -> DataFrame:
    """edges: (a, b) of longs. Returns (node, root) for every node that has an edge to another node;
    root is the smallest node of its component. Null ends and self-loops are ignored."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = scratch.write(now, f"{label}_0"), None
    for k in range(1, max_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.write(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}_{k}")
        state = now.agg(F.count("*"), F.expr("sum(xxhash64(u, v) div 4096)")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
