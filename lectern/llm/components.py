"""Connected components of a graph in a DataFrame, by alternating large and small stars.

The joins bring the least neighbour, one row a node, to all links of the node: a node of very many links is a skewed key of
one side only, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize


def _smallest(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """For each u of (u, v) with m the smallest of u and its v: (v, m) of the v that count, and (u, m)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("m"))
    joined = pairs.join(least, pairs.u == least.w).select("u", "v", "m")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach, itself included; unlinked nodes are absent.

    Null ends and loops are no links; repeated links count once; no links give no rows.  Each round writes its links
    into the shared folder, so that lineage stays short; the number of rounds grows with the logarithm of the size.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    before = None
    while True:
        now = materialize(now, "links")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state.n:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both, True).where("u > v").distinct()
        now = _smallest(large, False).where("u > v").distinct()
    least = now.groupBy("u").agg(F.min("v").alias("component"))
    return least.select(F.col("u").alias("node"), "component").union(least.select(F.col("component").alias("node"), "component").distinct())
