"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ephemera.llm.common import checkpointed


HOT = 1_000  # a node with more than this part of all rows is joined by broadcast; there are fewer than HOT such nodes
PART_ROWS = 4_000  # edges in a partition, at least: rounds shrink the table, and each task of a round leaves files


def _stars(pairs: DataFrame, most: float | None = None) -> DataFrame:
    """Rows (u, v, m): each neighbour v of u with m, the least of u and its neighbours.

    Minima are aggregated before the shuffle.  With ``most``, nodes of more neighbours get theirs by broadcast, so the
    rows of a hub stay where they are; the others meet theirs by a shuffle.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m0"), F.count("*").alias("n"))
    m = F.least("u", "m0").alias("m")
    if most is None:
        return pairs.join(least, "u").select("u", "v", m)
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m0"))  # fewer than HOT rows
    spread = pairs.join(hubs, "u").select("u", "v", m)
    return spread.unionByName(pairs.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= most), "u").select("u", "v", m))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Members of components with two nodes at least: (id, component), component = least id.

    ``edges`` has two integer columns, in either direction; null ends and loops are left out, and repeats do
    not matter.  Every step is a partial aggregation and a join, so no component and no hub is gathered in one task;
    the edges are checkpointed each round, until all are stars.  Rounds grow with the logarithm of the longest path.
    """
    a, b = edges.columns[:2]
    edges = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        n = edges.count()
        edges = edges.coalesce(max(1, math.ceil(n / PART_ROWS)))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, 2 * n / HOT).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now a node's smaller neighbours are few: what was a hub is the end of their edges
        small = _stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u <> v").distinct())
        ends = edges.select(F.col("v").alias("u")).distinct()
        if edges.join(ends, "u", "left_semi").isEmpty():
            # no node is both a member and an end: each component is one star around its least node
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends.select(F.col("u").alias("id"), F.col("u").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
