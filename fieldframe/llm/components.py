"""Connected components of a distributed edge list.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) on (a, b) rows; every step's edges
are written to the shared folder, so lineage stays short and lost executors
cost one step at most. The driver sees three sums a round. A node with very
many neighbours (the hub of a star) is not joined in one task: see spread_join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, spread_join, stash


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, small: bool, most: int) -> DataFrame:
    """Link each node's neighbours (the smaller ones, or the larger ones) to the least of them and itself. most: edges there are, or more."""
    near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) if small else _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", "n", F.least("a", "m").alias("m"))
    joined = spread_join(near, least, "a", most)
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component (least node reachable) for every node of an edge.

    edges: a, b of one orderable type, no nulls; loops, repeats and both
    directions are allowed. No edges: no rows. Raises if the rounds do not
    settle.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max(F.col("a") < F.col("b"))).first()
        if sums[0] == 0 or sums == seen:
            break
        seen = sums
        large = stash(_star(now, False, 2 * sums[0]), "large")
        small = stash(_star(large, True, 2 * sums[0]), "small")
        drop_stash(large)
        drop_stash(now)
        now = small
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    links = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return links.union(links.select(F.col("component").alias("node"), "component").distinct())
