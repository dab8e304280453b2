"""Streams with state of their own: debounced batches of changes, and statistics of tokens as they come.

State lives in Spark's store (lists, values and timers of each key), so a query
that is stopped or loses an executor goes on from its checkpoint.  In order of
time the results are those of the batch forms (`watch.debounce`, `token_stats`).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Entropies (nats) that are a spike, ask for a check, ask for a pause; tokens of the rolling window.  Fixed values.
SPIKE, VERIFY, PAUSE, WINDOW = 3.5, 3.0, 4.2, 10
_MEANS = ("tokens long, mean double, most double, smoothed double, spikes long, should_verify boolean, should_pause boolean, confidence double")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """While queries start: the store that lists and timers need."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class _Debounce(StatefulProcessor):
    """Pending changes of a watcher; they leave together when the oldest is old enough, by the watermark."""

    def __init__(self, wait: float):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, path string, kind string")
        self.batch = handle.getValueState("batch", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names are Spark's
        for frame in rows:
            self.pending.appendList(list(zip(frame["us"].tolist(), frame["path"].tolist(), frame["kind"].tolist(), strict=True)))
        self._wake()
        return iter(())

    def _wake(self) -> None:
        """One timer, when the oldest pending change is old enough."""
        due = (min(x[0] for x in self.pending.get()) + self.wait * 1_000_000) / 1000
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int(-(-due // 1)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.pending.get())
        n, out = (self.batch.get()[0] if self.batch.exists() else 0), []
        while waiting and (waiting[0][0] + self.wait * 1_000_000) / 1000 <= now:
            late = waiting[0][0] + self.wait * 1_000_000
            ready = [x for x in waiting if x[0] < late]
            waiting = waiting[len(ready) :]
            n += 1
            latest = {path: (us, kind) for us, path, kind in ready}
            out += [(*key, n, path, kind, us) for path, (us, kind) in latest.items()]
        self.batch.update((n,))
        if waiting:
            self.pending.put(waiting)
            self._wake()
        else:
            self.pending.clear()
        if out:
            yield pd.DataFrame(out, columns=["watcher", "batch", "path", "kind", "us"])

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, seconds: float = 2.0, edge: float = 0.2, late: str = "10 seconds") -> DataFrame:
    """watcher, batch, path, kind and us of a stream of changes (watcher, ts, path, kind): what is pending leaves as one batch, the last change of each path, once the oldest pending change is old enough.

    Time is that of the changes: a batch leaves when the watermark, `late` behind
    the newest change, has passed its due time.
    """
    kind = changes.schema["watcher"].dataType.simpleString()
    rows = changes.withWatermark("ts", late).select("watcher", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "path", "kind")
    return rows.groupBy("watcher").transformWithStateInPandas(_Debounce(seconds - edge), f"watcher {kind}, batch long, path string, kind string, us long", "append", "EventTime")


class _Tokens(StatefulProcessor):
    """Sums of a generation's tokens, and its last entropies."""

    def __init__(self, name: str, window: int):
        self.name, self.window = name, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, total double, most double, spikes long, verify boolean, pause boolean")
        self.last = handle.getListState("last", "entropy double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total, most, spikes, verify, pause = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0, False, False)
        last = [x[0] for x in self.last.get()] if self.last.exists() else []
        for entropy in pd.concat(list(rows)).sort_values("position")["entropy"].tolist():
            n, total, most = n + 1, total + entropy, max(most, entropy)
            last = [*last[-(self.window - 1) :], entropy]
            spikes, verify, pause = spikes + (entropy > SPIKE), verify or entropy > max(SPIKE, VERIFY), pause or entropy > PAUSE
        self.sums.update((n, total, most, spikes, verify, pause))
        self.last.put([(x,) for x in last])
        yield pd.DataFrame([(*key, n, total / n, most, sum(last) / len(last), spikes, verify, pause, max(0.05, 1 - total / n / 5))], columns=[self.name, "tokens", "mean", "most", "smoothed", "spikes", "should_verify", "should_pause", "confidence"])

    def close(self) -> None:
        pass


def token_stream(tokens: DataFrame, name: str, window: int = WINDOW) -> DataFrame:
    """Statistics of each generation (`name`) of a stream of (name, position, entropy), a row whenever tokens come."""
    kind = tokens.schema[name].dataType.simpleString()
    return tokens.select(name, "position", "entropy").groupBy(name).transformWithStateInPandas(_Tokens(name, window), f"`{name}` {kind}, {_MEANS}", "update", "None")


def token_stats(tokens: DataFrame, name: str, window: int = WINDOW) -> DataFrame:
    """The same of a table: the last `window` tokens of each generation come from one ranking."""
    e = F.col("entropy")
    last = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("position"))) <= window
    ranked = tokens.select(name, "position", "entropy", last.alias("last"))

    def share(test: Column) -> Column:
        return F.max(F.when(test, True).otherwise(False))

    sums = ranked.groupBy(name).agg(F.count("*").alias("tokens"), F.avg(e).alias("mean"), F.greatest(F.lit(0.0), F.max(e)).alias("most"), F.avg(F.when(F.col("last"), e)).alias("smoothed"), F.count_if(e > SPIKE).alias("spikes"), share(e > max(SPIKE, VERIFY)).alias("should_verify"), share(e > PAUSE).alias("should_pause"))
    return sums.withColumn("confidence", F.greatest(F.lit(0.05), 1 - F.col("mean") / 5))
