"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node of edges (a, b).

    Alternates large-star and small-star steps; every step is a grouped
    minimum and a join on one key, so no list of a node's neighbours is ever
    built, and a hub costs partial aggregates only.  The number of rounds is
    logarithmic in the longest path.  Each round is written to the shared
    folder.  Nodes without edges are not returned; self-loops count as nodes.
    """
    pairs = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
    now = materialize(pairs.where("u <> v").distinct(), "cc")
    before = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    for _ in range(max_rounds):
        # large star: every larger neighbour is linked to the least of the closed neighbourhood
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        forget(now)
        # small star: the smaller neighbours and the node itself are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        step = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(step, "cc")
        forget(large)
        after = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
