"""The store's operators: keyed upserts, inserts that ignore known keys, cascades, facts and statistics.

A store is a set of snapshots (DataFrames); a change is a new snapshot.  Keys are
natural, so applying a change twice changes nothing more.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after new rows replace those of their key, with `change`: added, updated, unchanged or kept."""
    values = [c for c in old.columns if c not in keys]
    mine, theirs = F.struct(*values).alias("old"), F.struct(*values).alias("new")
    joined = old.select(*keys, mine).join(new.select(*keys, theirs), keys, "full_outer")
    change = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return joined.select(*keys, *(F.coalesce(F.col("new"), F.col("old"))[v].alias(v) for v in values), change.alias("change"))


def reconcile(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys with their state: added, unchanged or resolved."""
    joined = before.select(key).distinct().withColumn("b", F.lit(1)).join(now.select(key).distinct().withColumn("n", F.lit(1)), key, "full_outer")
    return joined.select(key, F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "resolved").otherwise("unchanged").alias("state"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key is in neither old nor an equal new row."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def classify_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(finding_id, fingerprint, action, event): unchanged fingerprints are touched, changed ones make a fix event, new ones a discovery."""
    joined = new.select("finding_id", "fingerprint").join(old.select("finding_id", F.col("fingerprint").alias("known")), "finding_id", "left")
    action = F.when(F.col("known").isNull(), "insert").when(F.col("known") == F.col("fingerprint"), "touch").otherwise("update")
    return joined.select("finding_id", "fingerprint", action.alias("action"), F.when(action == "insert", "discovery").when(action == "update", "fix").alias("event"))


def delete_cascade(findings: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and relations without those in gone (finding_id), in either direction."""
    left = findings.join(gone, "finding_id", "left_anti")
    ends = gone.select(F.col("finding_id").cast("string").alias("g"))
    edges = relations
    for side in ("src", "dst"):
        edges = edges.join(ends, (F.col(f"{side}_kind") == "finding") & (F.col(f"{side}_id") == F.col("g")), "left_anti")
    return left, edges


def first_of(rows: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def fingerprint(*columns: str) -> Column:
    """The first ten hex digits of the md5 of columns joined by bars."""
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary")), 1, 10)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in the order, from 1, without a task that holds them all.

    One sort deals the rows to ranges; written out, so that it is not dealt anew,
    each row carries its range and its place there, and the sizes of the ranges
    before (a row a range) are added.
    """
    placed = settled(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    split = placed.withColumn("_range", F.shiftright("_at", 33))
    sizes = split.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return split.join(sizes.select("_range", before.alias("_before")), "_range").withColumn(name, place).drop("_at", "_range", "_before")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    dropped_later(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_settled: list[tuple[SparkSession, str]] = []


def dropped_later(spark: SparkSession, path: str) -> str:
    """A folder that goes when the process ends."""
    _settled.append((spark, path))
    return path


@atexit.register
def _drop_settled() -> None:
    for spark, path in _settled:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; its owner clears the folder
            return


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, in local mode a temporary folder, else the warehouse, which must then lie where all executors see it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and spark.sparkContext.master.split("[")[0] == "local":
        at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir")
        if at.startswith("file:") or "://" not in at:
            raise RuntimeError(f"spark.checkpoint.dir is unset, and the warehouse {at} is a folder of one machine: set spark.checkpoint.dir to a folder that all executors share")
    return f"{at.rstrip('/')}/tessera"


def stable_ids(found: DataFrame, known: DataFrame, prefix: str, year: int, order: list[Column]) -> DataFrame:
    """found (fingerprint, ...) with `id`: the known one of its fingerprint, else numbers after the largest known, in the order given."""
    joined = found.join(known.select("fingerprint", F.col("id").alias("known_id")), "fingerprint", "left")
    top = known.agg(F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("long")), F.lit(0)).alias("top"))
    fresh = joined.where("known_id IS NULL").crossJoin(F.broadcast(top))  # one row
    fresh = numbered(fresh, order, "_place")
    fresh = fresh.withColumn("id", F.format_string(f"{prefix}-{year}-%04d", F.col("top") + F.col("_place"))).drop("top", "known_id", "_place")
    return joined.where("known_id IS NOT NULL").withColumnRenamed("known_id", "id").unionByName(fresh)
