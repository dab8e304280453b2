"""Folds over ordered values of a group, without a task that holds the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import settled


def in_ranges(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """rows sorted by groups and order, written out, with `_range` (ascends in that order) and `_at` (place in the range)."""
    placed = settled(rows.orderBy(*groups, *order).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))


def ema(rows: DataFrame, groups: list[str], order: list[Column], value: str, start: float, alpha: float = 0.1, name: str = "ema") -> DataFrame:
    """groups and the moving average e = alpha x + (1 - alpha) e of each, over its values in order, from `start`.

    The last of n values weighs alpha, the one k places before it alpha (1 - alpha)^k,
    the start (1 - alpha)^n: ranges are summed with their own last value as the
    first, and each sum shrinks by the number of values in the ranges behind it.
    """
    keep = F.lit(1.0 - alpha)
    ranged = in_ranges(rows.where(F.col(value).isNotNull()).select(*groups, *[o.alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).cast("double").alias("_x")), groups, [F.col(f"_o{i}") for i in range(len(order))])
    back = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(F.desc("_at"))) - 1
    parts = ranged.withColumn("_k", back).groupBy(*groups, "_range").agg(F.count("*").alias("_n"), F.sum(F.col("_x") * F.lit(alpha) * F.pow(keep, F.col("_k"))).alias("_s"))
    behind = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    parts = parts.withColumn("_behind", behind)
    return parts.groupBy(*groups).agg((F.sum(F.col("_s") * F.pow(keep, F.col("_behind"))) + F.lit(float(start)) * F.pow(keep, F.sum("_n"))).alias(name))


def budgeted(rows: DataFrame, groups: list[str], order: list[Column], size: Column, budget: int, name: str = "used") -> DataFrame:
    """The first rows of each group whose sizes fit a budget together, in order, with the sum so far: what the ranges before have used comes from one row each."""
    ranged = in_ranges(rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0))), groups, order)
    used = ranged.groupBy(*groups, "_range").agg(F.sum("_size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    used = used.withColumn("_before", before).where(F.col("_before") <= budget).select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_before")
    met = ranged.join(used, [F.col("_range") == F.col("_r"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]])
    inside = F.sum("_size").over(Window.partitionBy(*groups, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn(name, F.col("_before") + inside).where(F.col(name) <= budget).drop("_size", "_range", "_at", "_before", "_r", *[f"_g{i}" for i in range(len(groups))])
