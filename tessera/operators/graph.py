"""Graph operators over edge lists (src, dst): breadth-first distances, paths and chains.

Each hop is a join of the frontier with the edges; visited vertices leave by an
anti-join.  Every frontier is written to the shared folder, so the plan of a hop
does not hold those before it; depths are bounded by parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import numbered, settled


def distances(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(node, depth) of the first visit from the starts (node), at most `depth` hops away."""
    e = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")) if reverse else edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    e = settled(e.distinct())
    seen = starts.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        frontier = settled(frontier.join(e, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int) -> DataFrame:
    """The first shortest simple path (start, end, path) from each start to each end it reaches within `hops`; of several, the least.

    A vertex that a start has reached keeps the vertex before it, and its number
    in the order of the paths to that depth; the numbers come from one sort of
    each frontier.  What was reached leaves the next frontier, and only the paths
    to ends are put together, backwards, once all depths are known.
    """
    e = settled(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct())
    reached = settled(starts.select(F.col("node").alias("start"), F.col("node").alias("at")).distinct().select("start", "at", F.lit(0).alias("depth"), F.lit(None).cast(starts.schema["node"].dataType).alias("before")))
    frontier = reached.select("start", "at", F.lit(0).cast("long").alias("place"))
    for depth in range(1, hops + 1):
        step = frontier.join(e, "at").select("start", F.col("next").alias("at"), F.struct("place", F.col("at").alias("before")).alias("via"))
        step = step.join(reached.select("start", "at"), ["start", "at"], "left_anti").groupBy("start", "at").agg(F.min("via").alias("via"))
        frontier = settled(numbered(step.select("start", "at", "via.*").withColumnRenamed("place", "_via"), [F.col("start"), F.col("_via"), F.col("at")], "place").drop("_via"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.select("start", "at", F.lit(depth).alias("depth"), "before"))
        frontier = frontier.select("start", "at", "place")
    hit = reached.where("depth > 0").join(ends.select(F.col("node").alias("at")).distinct(), "at", "left_semi")
    built = hit.select("start", F.col("at").alias("end"), "depth", F.col("before").alias("at"), F.array("before", "at").alias("path"))
    back = reached.where("depth > 0").select("start", "at", "before")
    for _ in range(hops - 1):
        built = built.join(back, ["start", "at"], "left").select("start", "end", "depth", F.col("before").alias("at"), F.when(F.col("before").isNotNull(), F.concat(F.array("before"), "path")).otherwise(F.col("path")).alias("path"))
    return built.select("start", "end", "path")
