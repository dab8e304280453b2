"""The state of registries of versions, from what was done to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The version of what was just created.
FIRST = 1


def state(events: DataFrame, registry: str, name: str, order: str, op: str, score: str) -> DataFrame:
    """(registry, name, version, score, active) of what each registry holds after all its events, in order.

    op: `create` begins anew; `register` adds a version with its score, and creates
    what is not there; `activate` counts for what is there at that time, and
    replaces what was active; `deactivate` leaves nothing active; `delete` takes
    away, and if it was active, nothing is.  Other operations are left out.
    """
    keys = [registry, name]
    rows = events.where(F.col(op).isin("create", "register", "delete", "activate", "deactivate")).select(registry, name, order, op, score)
    life = F.col(op).isin("create", "register", "delete")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.last(F.when(life, F.col(op)), ignorenulls=True).over(before), F.lit("delete")) != "delete"
    rows = rows.withColumn("_there", there)
    # what happened to each name: its last deletion, its last beginning, the registrations since
    last = rows.groupBy(*keys).agg(F.max(F.when(F.col(op) == "delete", F.col(order))).alias("_gone"), F.max(F.when((F.col(op) == "create") | ((F.col(op) == "register") & ~F.col("_there")), F.col(order))).alias("_begun"))
    last = last.where("_begun IS NOT NULL AND (_gone IS NULL OR _gone < _begun)")
    since = rows.where(F.col(op) == "register").join(last, keys).where(F.col(order) >= F.col("_begun")).groupBy(*keys).agg(F.count("*").alias("_n"), F.max_by(score, order).alias("_score"))
    # what was activated last, if nothing was switched off and it was not deleted since
    switched = rows.where(((F.col(op) == "activate") & F.col("_there")) | (F.col(op) == "deactivate")).groupBy(registry).agg(F.max(order).alias("_at"), F.max_by(F.when(F.col(op) == "activate", F.col(name)), order).alias("_active"))
    held = last.join(since, keys, "left").join(switched, registry, "left")
    active = F.col("_active").eqNullSafe(F.col(name)) & (F.col("_gone").isNull() | (F.col("_gone") < F.col("_at")))
    return held.select(*keys, (FIRST + F.coalesce("_n", F.lit(0))).alias("version"), F.coalesce("_score", F.lit(0.0)).alias(score), F.coalesce(active, F.lit(False)).alias("active"))
