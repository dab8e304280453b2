"""Sinks: JSON lines, one file a finding, markdown, snapshots and keyed updates of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import upsert


#: The column of a snapshot that says what its last update did with a row.
CHANGE = "_change"


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    """One text line a row."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def persist_findings(df: DataFrame, key: str, path: str) -> None:
    """One line of JSON a finding, with a time, in one of 256 folders by the key's hash: a key is found without reading the others."""
    folder = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 2)
    df.withColumns({"timestamp": F.unix_timestamp().cast("double"), "folder": folder}).repartition("folder").write.partitionBy("folder").mode("overwrite").json(path)


def _generations(spark: SparkSession, path: str) -> list[int]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    whole = lambda f: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))  # noqa: E731  a write that broke off does not count
    return sorted(int(f.getPath().getName()[4:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("gen-") and whole(f))


def load_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest generation of a snapshot."""
    found = _generations(spark, path)
    return spark.read.parquet(f"{path}/gen-{found[-1]:06d}").drop(CHANGE) if found else None


def save_snapshot(df: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """Write a new generation beside the old ones, so that readers of those are not disturbed; the oldest go."""
    spark = df.sparkSession
    found = _generations(spark, path)
    number = (found[-1] if found else 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/gen-{number:06d}")
    for old in found[: max(0, len(found) + 1 - keep)]:
        truncate(spark, f"{path}/gen-{old:06d}")
    return spark.read.parquet(f"{path}/gen-{number:06d}")


def save_updates(new: DataFrame, path: str, keys: list[str]) -> dict[str, int]:
    """Upsert rows into a snapshot; how many were added, updated, unchanged and kept.

    One write makes the next generation, with each row's change beside it.
    """
    old = load_snapshot(new.sparkSession, path)
    if old is None:
        old = new.limit(0)
    after = upsert(old, new.dropDuplicates(keys), keys).withColumnRenamed("change", CHANGE)
    return {r[CHANGE]: r["count"] for r in save_snapshot(after, path).groupBy(CHANGE).count().collect()}


def truncate(spark: SparkSession, path: str) -> None:
    """Delete a table's folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
