"""Streams with state give what their batch forms give, over several micro-batches and a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import stateful, watch

START = dt.datetime(2024, 1, 1)


def run(spark, at, rows, schema, build, mode, parts):
    """The rows that a query over a folder emits; the files come one by one, and the query starts anew for each."""
    got = []
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if mode == "update" else rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{at}/in"))
        with stateful.state_store(spark):
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(lambda df, n: got.extend(df.collect())).trigger(availableNow=True).start()
            query.awaitTermination()
    return got


def test_debounced(spark, tmp_path):
    rng = random.Random(6)
    rows, t = [], 0.0
    for i in range(120):
        t += rng.choice([0.11, 0.37, 0.93, 1.85, 5.03])
        rows.append((i % 2, START + dt.timedelta(seconds=t), f"f{rng.randrange(5)}", rng.choice(["modify", "create", "delete"])))
    end = [(w, START + dt.timedelta(days=1), "end", "modify") for w in (0, 1)]  # closes what is pending
    schema = "watcher int, ts timestamp, path string, kind string"
    got = run(spark, tmp_path, rows + end, schema, lambda s: stateful.debounced(s, 2.0, 0.2, "1 second"), "append", 3)
    batched = watch.debounce(spark.createDataFrame(rows, schema), 2.0, 0.2)
    want = {(r.watcher, r.batch, r.path): (r.kind, r.us) for r in batched.groupBy("watcher", "batch", "path").agg(F.max_by("kind", "ts").alias("kind"), F.max(F.unix_micros("ts")).alias("us")).collect()}
    assert len({k[:2] for k in want}) > 20
    assert {(r.watcher, r.batch, r.path): (r.kind, r.us) for r in got} == want and len(got) == len(want)


def test_token_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"g{i % 3}", i, rng.random() * (5 if i % 3 else 3)) for i in range(90)]
    rows = sorted(rows, key=lambda r: r[1] // 30)
    schema = "generation string, position int, entropy double"
    chunks = []
    got = []
    for k in range(3):
        chunks = rows[k * 30 : (k + 1) * 30]
        spark.createDataFrame(chunks, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.token_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "generation")
        with stateful.state_store(spark):
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(lambda df, n: got.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
    last = {r.generation: r for r in got}
    want = {r.generation: r for r in stateful.token_stats(spark.createDataFrame(rows, schema), "generation").collect()}
    assert len(got) == 9 and set(last) == set(want)
    for g, r in want.items():
        for name in ("tokens", "mean", "most", "smoothed", "spikes", "should_verify", "should_pause", "confidence"):
            assert last[g][name] == pytest.approx(r[name]), (g, name)
    assert want["g0"].should_pause is False and want["g1"].should_pause is True
