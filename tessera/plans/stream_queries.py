"""Streaming operators over events, as batches (a stream gives the same, see the tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import stateful, watch
from .registry import Tables, query
from .surface_queries import scratch


def changes(t: Tables) -> DataFrame:
    return t.events.select("ts", F.concat(F.lit("u"), "user_id").alias("path"), F.when(F.col("event_type") == "view", "move").otherwise(F.col("event_type")).alias("kind"), F.concat(F.lit("v"), "user_id").alias("target"), (F.col("event_id") % 4).alias("watcher"))


_C = "c AS (SELECT ts, 'u' || user_id AS path, CASE event_type WHEN 'view' THEN 'move' ELSE event_type END AS kind, 'v' || user_id AS target, event_id % 4 AS watcher FROM events)"


@query("x1_event_source", f"WITH {_C} SELECT ts, path, CASE kind WHEN 'move' THEN 'delete' ELSE kind END AS kind FROM c UNION ALL SELECT ts, target, 'modify' FROM c WHERE kind = 'move'")
def event_source(t: Tables) -> DataFrame:
    return watch.moves_apart(changes(t))


@query("x2_enqueue_filter", f"WITH {_C} SELECT ts, path FROM c WHERE NOT ends_with(path, '7') AND kind <> 'click'")
def enqueue_filter(t: Tables) -> DataFrame:
    return changes(t).where(~F.col("path").endswith("7") & (F.col("kind") != "click")).select("ts", "path")


@query("x3_debounce", "WITH RECURSIVE e AS (SELECT event_id % 4 AS watcher, epoch(ts) AS t, row_number() OVER (PARTITION BY event_id % 4 ORDER BY ts, event_id) AS k FROM events), r AS (SELECT watcher, k, t AS opened, 1 AS batch FROM e WHERE k = 1 UNION ALL SELECT e.watcher, e.k, CASE WHEN e.t - r.opened >= 599.8 THEN e.t ELSE r.opened END, CASE WHEN e.t - r.opened >= 599.8 THEN r.batch + 1 ELSE r.batch END FROM r JOIN e ON e.watcher = r.watcher AND e.k = r.k + 1) SELECT watcher, batch, count(*) AS n FROM r GROUP BY ALL")
def debounce(t: Tables) -> DataFrame:
    rows = t.events.select("ts", (F.col("event_id") % 4).alias("watcher"))
    return watch.debounce(rows, 600.0, 0.2).groupBy("watcher", "batch").agg(F.count("*").alias("n"))


@query("x4_dedup_by_path", f"WITH {_C} SELECT path, arg_max(kind, ts) AS kind, max(ts) AS ts FROM c GROUP BY path")
def dedup_by_path(t: Tables) -> DataFrame:
    return watch.latest(changes(t))


@query("x8_polling_watcher", "SELECT doc_id FROM documents WHERE n_chars > 2000 OR doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)")
def polling_watcher(t: Tables) -> DataFrame:
    """Files that are new or changed since they were seen."""
    seen = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.lit(2000).cast("long").alias("mtime"))
    return t.documents.select("doc_id", F.col("n_chars").alias("now")).join(seen, "doc_id", "left").where("mtime IS NULL OR now > mtime").select("doc_id")


@query("x9_incremental_rescan", "WITH b AS (SELECT DISTINCT substring(md5(text), 1, 10) AS f FROM documents WHERE doc_id % 7 <> 2), n AS (SELECT DISTINCT substring(md5(text), 1, 10) AS f FROM documents WHERE doc_id % 7 <> 1) SELECT coalesce(b.f, n.f) AS fingerprint, CASE WHEN b.f IS NULL THEN 'added' WHEN n.f IS NULL THEN 'resolved' ELSE 'unchanged' END AS state FROM b FULL JOIN n ON b.f = n.f")
def incremental_rescan(t: Tables) -> DataFrame:
    # what a file held before and after a change: two snapshots, each without a seventh
    d = t.documents.select("doc_id", F.substring(F.md5(F.col("text").cast("binary")), 1, 10).alias("fingerprint"))
    return watch.rescan(d.where("doc_id % 7 <> 2"), d.where("doc_id % 7 <> 1"))


_STATS = "WITH e AS (SELECT user_id, event_id, value / 10 AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10 AS last FROM events) SELECT user_id, count(*) AS tokens, round(avg(h), 6) AS mean, round(greatest(0, max(h)), 6) AS most, round(avg(h) FILTER (last), 6) AS smoothed, count(*) FILTER (h > 3.5) AS spikes, bool_or(h > 3.5) AS should_verify, bool_or(h > 4.2) AS should_pause, round(greatest(0.05, 1 - avg(h) / 5), 6) AS confidence FROM e GROUP BY user_id"


def _tokens(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.col("event_id").alias("position"), (F.col("value") / 10).alias("entropy"))


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.select("user_id", "tokens", "spikes", "should_verify", "should_pause", *[F.round(c, 6).alias(c) for c in ("mean", "most", "smoothed", "confidence")])


@query("x10_token_stats", _STATS)
def token_stats(t: Tables) -> DataFrame:
    """Statistics of every user's tokens, as a stream that is stopped half way and goes on from its checkpoint."""
    at, out, checkpoint = scratch(t, "tokens"), scratch(t, "token-stats"), scratch(t, "checkpoint")
    rows = _tokens(t)
    half = rows.agg(F.percentile_approx("position", 0.5)).first()[0]
    for part in (F.col("position") <= half, F.col("position") > half):
        rows.where(part).write.mode("append").parquet(at)
        stream = stateful.token_stream(t.spark.readStream.schema(rows.schema).parquet(at), "user_id")
        with stateful.state_store(t.spark):
            stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    seen = t.spark.read.parquet(out)
    last = seen.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in seen.columns if c not in ("user_id", "batch")]), "batch").alias("s"))
    return _rounded(last.select("user_id", "s.*"))


@query("x10_token_stats_table", _STATS)
def token_stats_table(t: Tables) -> DataFrame:
    """The same of the whole table at once."""
    return _rounded(stateful.token_stats(_tokens(t), "user_id"))


@query("x3_tumbling_activity", "SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def tumbling_activity(t: Tables) -> DataFrame:
    return watch.activity(t.events.withColumnRenamed("event_type", "kind"))


@query("m35_session_lifecycle", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def session_lifecycle(t: Tables) -> DataFrame:
    return watch.sessions(t.events)
