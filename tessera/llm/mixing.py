"""Operator 3: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws a key -ln(u) / weight, with u from a hash of its id and text
and the weight from its quality, so reruns agree.  A source's target is met by
complete epochs of all its documents, then by the documents of least key up to
the rest of the budget; the document at the border gives the words that are left.

No source is sorted as a whole: keys are whole numbers of 52 bits.  Per source
the words of keys that share their first bits are summed, the sums of at most
4,096 such cells are prefix-summed, and the cell in which the budget ends is cut
by the next bits, for its rows alone.  What shares the last cell, some 2**-28 of
a source, is sorted.  Tables of sources hold a row a source.

Defined cases: a null or empty text has size 0 and gives nothing; null is a
source of its own and comes last; equal rows draw equal keys and share their
place in any order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Bits of a key after the point and in all, and bits of a key that are left after each round.
POINT, BITS, ROUNDS = 42, 52, (40, 28, 14)
SHARE, CYCLE, MOST = 1.5, (3, 1, 2), 2
WORD = r"[^\x20\x09-\x0D]+"


def letter_share(text: str = "text") -> Column:
    """A document's quality weight: the share of its characters that are not digits or marks, from 0.05 to 1."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.greatest(F.lit(0.05), F.coalesce(F.length(F.translate(t, "0123456789|$%&#*<>{}[]=+_/\\@!", "")) / F.nullif(F.length(t), F.lit(0)), F.lit(0.05)))


def targets(sizes: DataFrame, share: float = SHARE, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """Targets of sources (source, source_size): the weights' shares of the budget, capped at `most` times the size.

    With the sources sorted by cap over weight, those that are capped come
    first; the level at which the rest share what is left follows from prefix sums.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), ((F.row_number().over(ordered) - 1) % len(cycle) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, all_ = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(all_) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("level")))).over(all_)["level"]
    return w.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def _border(rows: DataFrame, plan: DataFrame, rounds: tuple[int, ...]) -> DataFrame:
    """Per source (s): the cell (first bits of keys) in which `rest` ends, and the words of the cells before."""
    state, had = plan.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("before")), BITS + 10
    for left in rounds:
        met = rows.join(state, F.expr(f"source <=> s AND shiftright(_order, {had}) = cut"))
        cells = met.groupBy("s", F.shiftright("_order", left).alias("cell")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        ends = cells.withColumn("upto", upto).where("upto > rest").groupBy("s").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("at"))
        state, had = materialize(ends.select("s", "at.rest", F.col("at.cell").alias("cut"), "at.before"), "border"), left
    return state


def mix(docs: DataFrame, weight: Column | None = None, share: float = SHARE, cycle: tuple[int, ...] = CYCLE, most: int = MOST, rounds: tuple[int, ...] = ROUNDS, seed: int = 17) -> DataFrame:
    """doc_id, _key (hash of the text), size, source, source_size, target, epochs (whole passes), part (words of the last pass), taken."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_key"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_hash"), (letter_share() if weight is None else weight).cast("double").alias("_weight"))
    u = (F.pmod("_hash", F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    draw = -F.ln(u) / F.greatest(F.col("_weight"), F.lit(1e-12))
    rows = materialize(rows.withColumn("_order", F.least(F.floor(draw * float(1 << POINT)), F.lit((1 << BITS) - 1)).cast("long")).drop("_weight"), "draws")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    plan = targets(sizes, share, cycle, most).withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0)) + 1e-12), F.lit(0)).cast("long"))
    plan = materialize(plan.withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 1e-6)).cast("long")), "targets")
    plan = materialize(plan.join(_border(rows, plan, rounds).drop("rest"), F.expr("source <=> s"), "left").drop("s", "weight"), "plan")
    met = rows.join(plan.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s").withColumn("_cell", F.shiftright("_order", rounds[-1]))
    sure = met.where("cut IS NULL OR _cell <> cut").withColumn("part", F.expr("CASE WHEN cut IS NULL OR _cell < cut THEN least(size, rest) ELSE 0 END"))
    inner = Window.partitionBy("source").orderBy("_order", "_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = met.where("_cell = cut").withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inner), F.lit(0)))))
    return sure.unionByName(last).select("doc_id", "_key", "size", "source", "source_size", "target", "epochs", F.col("part").cast("long").alias("part"), (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
