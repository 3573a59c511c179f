"""Connected components of a distributed edge list by alternating large and small stars.

Every round rewrites the edges towards the smallest neighbour; it stops when the edges no longer change, and are then a
star around the smallest node of each component. A round emits at most two rows an edge, minima are partly aggregated
before the shuffle, a join can split the edges of a hub, and the lineage is cut by checkpoints, so a lost executor costs
only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge to another. Self loops and nulls
    are no edges; no edges give an empty result."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = checkpoint(now)
    before = _mark(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        # Grouped by a struct, so that the partitions of the groups don't serve the join too: adaptive execution splits a
        # hub's edges only between two plain shuffles. Merged, so that no list of nodes is broadcast through the driver.
        least = both.groupBy(F.struct("u").alias("g")).agg(F.min("v").alias("m")).select("g.u", "m").select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        least = large.groupBy(F.struct("u").alias("g")).agg(F.min("v").alias("m")).select("g.u", "m")
        small = large.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
