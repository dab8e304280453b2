"""Streams of file changes: filter, debounce, latest change per path, micro-batches and windows.

Every step is a function of DataFrames, so batch and stream give the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import reconcile
from ..sources import sinks


def moves_apart(events: DataFrame) -> DataFrame:
    """A move (path, target) becomes a deletion and a modification."""
    two = F.array(F.struct(F.col("path").alias("path"), F.lit("delete").alias("kind")), F.struct(F.col("target").alias("path"), F.lit("modify").alias("kind")))
    one = F.array(F.struct(F.col("path").alias("path"), F.col("kind").alias("kind")))
    return events.withColumn("e", F.explode(F.when(F.col("kind") == "move", two).otherwise(one))).select("ts", "e.*")


def debounce(events: DataFrame, seconds: float = 2.0, edge: float = 0.2) -> DataFrame:
    """`batch`: all that is pending is drained when the oldest pending event is old enough.

    A pause as long as the wait always opens a batch, so the times of a watcher
    fall apart at pauses; within a stretch each batch is one search from its
    first event, and the numbers of batches in the stretches before are added.
    """
    wait = seconds - edge
    by = Window.partitionBy("watcher").orderBy("t")
    times = events.select("watcher", F.col("ts").cast("timestamp").cast("double").alias("t")).distinct()
    pause = F.coalesce(F.col("t") - F.lag("t").over(by) >= wait, F.lit(True)).cast("long")
    cut = times.withColumn("pause", pause).withColumn("stretch", F.sum("pause").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("pause")
    kind = cut.schema["watcher"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        t = np.sort(group.column("t").to_numpy())
        heads, at = [], 0
        while at < len(t):
            heads.append(at)
            # the first time that is late enough by the same subtraction as everywhere
            at = int(np.searchsorted(t, t[at] + wait, "left"))
            while at > heads[-1] + 1 and t[at - 1] - t[heads[-1]] >= wait:
                at -= 1
            while at < len(t) and t[at] - t[heads[-1]] < wait:
                at += 1
        batch = np.repeat(np.arange(1, len(heads) + 1), np.diff([*heads, len(t)]))
        one = np.zeros(len(t), np.int64)
        return pa.Table.from_arrays([group.column("watcher").combine_chunks().take(pa.array(one)), pa.array(one + group.column("stretch")[0].as_py()), pa.array(t), pa.array(batch)], names=["watcher", "stretch", "t", "local"])

    marks = cut.groupBy("watcher", "stretch").applyInArrow(run, f"watcher {kind}, stretch long, t double, local long")
    sizes = cut.groupBy("watcher", "stretch").applyInArrow(lambda g: pa.Table.from_arrays([x for x in run(g).select(["watcher", "stretch", "local"]).slice(g.num_rows - 1).columns], names=["watcher", "stretch", "n"]), f"watcher {kind}, stretch long, n long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("watcher").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = marks.join(sizes.select("watcher", "stretch", before.alias("before")), ["watcher", "stretch"]).select("watcher", "t", (F.col("local") + F.col("before")).cast("int").alias("batch"))
    return events.withColumn("t", F.col("ts").cast("timestamp").cast("double")).join(numbered, ["watcher", "t"]).drop("t")


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """The last change of each path."""
    return events.groupBy(*keys, "path").agg(F.max_by("kind", "ts").alias("kind"), F.max("ts").alias("ts"))


def activity(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and kind; in a stream, rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: runs of events without a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class Watcher:
    """A stream of changes applied to a snapshot in micro-batches.

    The snapshot lives in generations of a folder (`sinks.save_updates`), so no
    plan grows with the batches and another process can go on.  Rows that
    `sound` does not accept are counted and left out, the others of their batch
    are applied.  Any other failure, such as a lost executor, ends the stream
    with the batch unapplied: the checkpoint stays behind it, and the next start
    applies it.
    """

    def __init__(self, path: str, key: str, handle: Callable[[DataFrame], DataFrame] | None = None, sound: Column | None = None):
        self.path, self.key, self.handle = path, key, handle or (lambda df: df)
        self.sound = F.lit(True) if sound is None else F.coalesce(sound, F.lit(False))
        self.batches = self.errors = self.added = self.updated = 0
        self.query: StreamingQuery | None = None
        self._again: Callable[[], StreamingQuery] | None = None

    def apply(self, batch: DataFrame, number: int) -> None:
        """Idempotent: a batch that is applied again changes nothing."""
        good = batch.where(self.sound)
        bad = batch.where(~self.sound).count()
        counts = sinks.save_updates(self.handle(good).dropDuplicates([self.key]), self.path, [self.key])
        self.added += counts.get("added", 0)
        self.updated += counts.get("updated", 0)
        self.errors += bad
        self.batches += 1

    def snapshot(self, spark: SparkSession) -> DataFrame | None:
        return sinks.load_snapshot(spark, self.path)

    def start(self, stream: DataFrame, checkpoint: str, seconds: int = 2, once: bool = False) -> StreamingQuery:
        def run() -> StreamingQuery:
            writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
            return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()

        self._again, self.query = run, run()
        return self.query

    def pause(self) -> None:
        """Stop taking batches; what arrives meanwhile waits in the source."""
        if self.query is not None:
            self.query.stop()
            self.query = None

    def resume(self) -> StreamingQuery:
        """Go on behind the last applied batch."""
        if self._again is None:
            raise RuntimeError("not started")
        self.query = self._again()
        return self.query

    def stop(self) -> None:
        self.pause()
        self._again = None

    def status(self) -> dict[str, object]:
        running = self.query is not None and self.query.isActive
        return {"running": running, "paused": not running and self._again is not None, "batches": self.batches, "errors": self.errors, "added": self.added, "updated": self.updated}


def rescan(before: DataFrame, now: DataFrame) -> DataFrame:
    """Fingerprints before and after a change: added, unchanged or resolved."""
    return reconcile(before, now, "fingerprint")
