"""Operator 10: sharding by extendible hashing, with DataFrame functions only.

A document's hash is read bit by bit.  The directory begins as one bucket.  In
each round the buckets over the limit, and only they, are split on their next
`step` bits; a bucket is final at the least number of bits at which it fits.
Rounds work on byte counts of hash-prefix cells, not on the rows; the rows are
read once to count the cells and once to look up their shards.  Cells that are
still too large are counted again by the next `width` bits, first of the id's
hash, then of the row's content, for their rows alone.  Rows that agree in both
are equal in id and text; they fill numbered pages, each part of the input its own.

Defined cases: a null or empty text has no bytes; a null id hashes as an empty
one; a single document over the limit is a shard of its own (the only kind that
exceeds it); an empty table has no shards; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialize, table

#: Bytes of a shard.
LIMIT = 64 << 20
#: The registered query's limit: small tables take several rounds of splits by it, too.
QUERY_LIMIT = 16 << 10
#: Bits of each of the two hashes, and bits that a round adds.
WIDTH, STEP = 60, 3
#: Buckets at most that are broadcast.
FEW = 1 << 14


def _bits(hexed: Column) -> Column:
    """The first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(hexed, 1, WIDTH // 4), 16, 10).cast("long")


def _split(cells: DataFrame, paths: int, bits: int, depth: int, step: int, limit: int) -> DataFrame:
    """cells (path, cell of `bits` bits, bytes, docs) of oversized buckets of `depth` bits, each with `at`: its bucket after up to `step` more bits, or null.

    The buckets that fit are broadcast while their number has a small bound.
    Otherwise, and in the other joins, rows are merged: Spark would judge a table
    by its compressed files, and the driver would hold rows many times as large.
    """
    deepest = min(bits, depth + step)
    levels = cells.withColumn("more", F.explode(F.sequence(F.lit(depth + (1 if depth else 0)), F.lit(deepest)))).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - more)"))
    fits = levels.groupBy("path", "more", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).where(f"shard_bytes <= {limit} OR shard_docs = 1").drop("shard_docs")
    met = levels.join(fits.hint("broadcast" if 2 * paths << deepest <= FEW else "merge"), ["path", "more", "prefix"], "left")
    at = F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("more", "prefix", "shard_bytes"))).alias("at")
    return met.groupBy("path", "cell").agg(F.first("bytes").alias("bytes"), F.first("docs").alias("docs"), at)


def _directory(cells: DataFrame, bits: int, step: int, limit: int) -> DataFrame:
    """path, cell and `at` (more, prefix, shard_bytes) of every cell; `at` is null where all bits leave its bucket too large."""
    done, depth = None, 0
    paths = cells.select("path").distinct().count()
    while True:
        met = materialize(_split(cells, paths, bits, depth, step, limit), "round")
        final = met.where("at IS NOT NULL").select("path", "cell", "at")
        done = final if done is None else done.unionByName(final)
        depth = min(bits, depth + step)
        cells = met.where("at IS NULL").drop("at")
        if depth == bits or cells.isEmpty():
            return done.unionByName(cells.select("path", "cell", F.lit(None).cast("struct<more:int,prefix:bigint,shard_bytes:bigint>").alias("at")))


def shard(docs: DataFrame, limit: int = LIMIT, width: int | None = None, step: int = STEP) -> DataFrame:
    """doc_id, n_bytes, shard (name), depth (hash bits used) and shard_bytes for every row of docs.

    width: hash bits of a cell; by default some six more than the directory's depth.
    """
    rows = materialize(
        docs.select(
            F.col("doc_id"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            _bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).alias("h1"),
            _bits(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("h2"),
        ),
        "sizes",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    width = width or min(WIDTH // 2, (total // limit).bit_length() + 6)
    done: list[DataFrame] = []
    left = rows.withColumn("path", F.lit("").cast("string"))
    for number, value in enumerate(("h1", "h2")):
        for used in range(0, WIDTH, width):
            bits = min(width, WIDTH - used)
            # bits that led here were the same for all rows of a path
            here = left.withColumn("cell", F.expr(f"shiftright({value}, {WIDTH - used - bits}) & {(1 << bits) - 1}"))
            cells = materialize(here.groupBy("path", "cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")), "cells")
            found = materialize(_directory(cells, bits, step, limit), "directory")
            forget(cells)
            met = here.join(found.hint("merge"), ["path", "cell"])
            depth = F.lit(number * WIDTH + used) + F.col("at.more")
            prefix = F.expr(f"shiftright({value}, {WIDTH - used} - at.more)").cast("string")
            name = F.concat(F.lit("") if number == 0 else F.col("path"), depth.cast("string"), F.lit(":"), prefix)
            done.append(met.where("at IS NOT NULL").select("doc_id", "n_bytes", name.alias("shard"), depth.cast("int").alias("depth"), F.col("at.shard_bytes").alias("shard_bytes")))
            if found.where("at IS NULL").isEmpty():
                return _all(done)
            left = materialize(met.where("at IS NULL").select("doc_id", "n_bytes", "h1", "h2", F.concat("path", F.lit(f"{number}."), F.col("cell").cast("string"), F.lit("/")).alias("path")), "oversized")
    # equal rows have one size; a part of the input numbers its own
    own = Window.partitionBy("path", "part").orderBy("n_bytes")
    paged = left.withColumn("part", F.spark_partition_id())
    paged = paged.withColumn("page", F.floor((F.row_number().over(own) - 1) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), "n_bytes")))))
    pages = paged.groupBy("path", "part", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    done.append(paged.join(pages.hint("merge"), ["path", "part", "page"]).select("doc_id", "n_bytes", F.concat("path", F.lit("page:"), F.col("part").cast("string"), F.lit("."), F.col("page").cast("string")).alias("shard"), F.lit(2 * WIDTH).cast("int").alias("depth"), "shard_bytes"))
    return _all(done)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), QUERY_LIMIT)


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
l AS (SELECT *, unnest(range(0, 61))::INT AS depth FROM d),
p AS (SELECT *, h >> (60 - depth) AS prefix FROM l),
t AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS docs FROM p GROUP BY ALL HAVING sum(n_bytes) <= {QUERY_LIMIT} OR count(*) = 1),
r AS (SELECT p.*, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM p JOIN t USING (depth, prefix))
SELECT doc_id, n_bytes, depth || ':' || prefix AS shard, depth, shard_bytes FROM r WHERE k = 1
"""
