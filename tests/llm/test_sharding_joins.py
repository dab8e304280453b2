"""op10's joins: only what has a small bound is broadcast, however small the files of a table are."""

from pyspark.sql import functions as F

from tessera.llm import sharding


def test_no_cells_are_broadcast(spark):
    cells = spark.range(1 << 12).select(F.lit("").alias("path"), F.col("id").alias("cell"), F.lit(10).cast("long").alias("bytes"), F.lit(2).cast("long").alias("docs"))
    plan = lambda depth: sharding._split(cells, 1, 30, depth, 3, 40)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(0) and "BroadcastHashJoin" not in plan(18) and "SortMergeJoin" in plan(18)


def test_split(spark):
    """Each cell gets its first bucket that fits, whether the buckets are broadcast or merged."""
    sizes = {c: 5 + c * 7 % 40 for c in range(0, 64, 3)}
    cells = spark.createDataFrame([("p", c, n, 2) for c, n in sizes.items()], "path string, cell long, bytes long, docs long")
    for paths in (1, 1 << 20):
        got = {r.cell: (r.bytes, r.docs, tuple(r.at) if r["at"] else None) for r in sharding._split(cells, paths, 6, 0, 6, 100).collect()}
        want = {}
        for c, n in sizes.items():
            sums = [sum(m for x, m in sizes.items() if x >> (6 - k) == c >> (6 - k)) for k in range(7)]
            k = next((k for k in range(7) if sums[k] <= 100), None)
            want[c] = (n, 2, None if k is None else (k, c >> (6 - k), sums[k]))
        assert got == want


def test_rows_are_merged(spark):
    """Equal rows compress to nothing; neither they nor their cells are broadcast."""
    docs = spark.range(3000).select((F.col("id") % 500).alias("doc_id"), F.lit("x" * 100).alias("text"))
    plan = sharding.shard(docs, 5000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
