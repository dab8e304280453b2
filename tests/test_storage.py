"""Snapshots and stateful streams."""

import pytest

from tessera.sources import sinks
from tessera.streaming import state


def test_snapshots(spark, tmp_path):
    at = str(tmp_path / "snap")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.load_snapshot(spark, at) is None
    assert sinks.save_updates(rows, at, ["k"]) == {"added": 2}
    assert sinks.save_updates(rows, at, ["k"]) == {"unchanged": 2}
    assert sinks.save_updates(spark.createDataFrame([(2, "c")], "k int, v string"), at, ["k"]) == {"kept": 1, "updated": 1}
    assert {tuple(r) for r in sinks.load_snapshot(spark, at).collect()} == {(1, "a"), (2, "c")}
    sinks.truncate(spark, at)
    assert sinks.load_snapshot(spark, at) is None


def test_router_state(spark, tmp_path):
    rows = [("tiny", 1, 0.9, 100.0), ("tiny", 2, 80.0, 200.0), ("small", 1, 0.2, 50.0)]
    spark.createDataFrame(rows, "tier string, seq int, confidence double, latency double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tier string, seq int, confidence double, latency double").parquet(str(tmp_path / "in"))
    got: dict = {}
    q = state.router_state(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: got.update({r.tier: r for r in df.collect()})).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got["tiny"].queries == 2
    assert got["tiny"].confidence == pytest.approx(0.1 * 0.8 + 0.9 * (0.1 * 0.9 + 0.9 * 0.5))
