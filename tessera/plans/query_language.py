"""Queries of the query language, over the tables that stand for its entities."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dsl
from .registry import Tables, query

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
#: Order priorities stand for severities, in rising order.
PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


def events(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit("brain").alias("source_tool"), F.col("ts").alias("timestamp"), F.col("props").alias("description"), F.col("user_id").alias("symbol_id"), "value")


def symbols(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("filepath"), F.col("p_partkey").alias("line"), F.col("p_name").alias("signature"), F.col("p_size").alias("complexity"), (F.col("p_size") * 3).alias("lines"))


def findings(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("finding_id"), F.lit("vuln").alias("kind"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("severity"), (F.col("o_totalprice") / 1e6).alias("confidence"), F.col("o_custkey").cast("string").alias("filepath"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("description"), F.col("o_orderdate").alias("created_at"))


def ask(t: Tables, text: str) -> DataFrame:
    return dsl.run(text, {"events": events(t), "symbols": symbols(t), "findings": findings(t)}, NOW, order=PRIORITIES)


_E = "SELECT event_id AS id, event_type AS kind, 'brain' AS source_tool, ts AS timestamp, props AS description, user_id AS symbol_id, value FROM events"
_S = "SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS filepath, p_partkey AS line, p_name AS signature, p_size AS complexity, p_size * 3 AS lines FROM part"
_RANK = "CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE -1 END"


@query("s1_scan_table", f"{_E} ORDER BY ts DESC, event_id LIMIT 100")
def scan_table(t: Tables) -> DataFrame:
    return ask(t, "events")


@query("f3_dsl_events", f"{_E} WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id LIMIT 50")
def dsl_events(t: Tables) -> DataFrame:
    return ask(t, "events where kind = error and since = 2024-01-15 limit 50")


@query("f4_comparison", f"{_S} WHERE p_size >= 10 AND p_size < 20 AND p_type != 'x' ORDER BY p_brand, p_partkey, p_name LIMIT 500")
def comparison(t: Tables) -> DataFrame:
    return ask(t, "symbols where complexity >= 10 and complexity < 20 and kind != 'x' limit 500")


@query("f5_filter_substring", f"{_S} WHERE contains(lower(p_name), 'an') ORDER BY p_brand, p_partkey, p_name LIMIT 300")
def filter_substring(t: Tables) -> DataFrame:
    return ask(t, "symbols where name ~ AN limit 300")


@query("f6_filter_ordered_enum", f"SELECT o_orderkey AS finding_id, o_orderpriority AS severity, o_orderdate AS created_at FROM orders WHERE {_RANK} >= 3 ORDER BY {_RANK} DESC, o_orderdate DESC, o_orderkey LIMIT 200")
def filter_ordered_enum(t: Tables) -> DataFrame:
    return ask(t, "findings where severity >= '2-HIGH' limit 200").select("finding_id", "severity", "created_at")


@query("f7_filter_enum_eq", f"SELECT o_orderkey AS finding_id, o_orderpriority AS severity, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def filter_enum_eq(t: Tables) -> DataFrame:
    return ask(t, "findings where severity = '1-urgent'").select("finding_id", "severity", "created_at")


@query("f8_filter_since", f"{_E} WHERE ts >= TIMESTAMP '2024-06-01' - INTERVAL 150 DAY ORDER BY ts DESC, event_id LIMIT 80")
def filter_since(t: Tables) -> DataFrame:
    return ask(t, "events where since = 150d limit 80")


@query("f9_nl_to_dsl", f"{_S} WHERE p_size > 10 ORDER BY p_brand, p_partkey, p_name LIMIT 50")
def nl_to_dsl(t: Tables) -> DataFrame:
    return ask(t, dsl.route("show the most complex symbols"))


@query("l1_symbols_by_place", f"{_S} ORDER BY p_brand, p_partkey, p_name LIMIT 40")
def symbols_by_place(t: Tables) -> DataFrame:
    return ask(t, "symbols limit 40")


@query("l2_findings_by_severity", f"SELECT o_orderkey AS finding_id, o_orderpriority AS severity, o_orderdate AS created_at FROM orders ORDER BY {_RANK} DESC, o_orderdate DESC, o_orderkey LIMIT 60")
def findings_by_severity(t: Tables) -> DataFrame:
    return ask(t, "findings limit 60").select("finding_id", "severity", "created_at")


@query("l3_timeline", f"{_E} ORDER BY ts DESC, event_id LIMIT 25")
def timeline(t: Tables) -> DataFrame:
    return ask(t, "events limit 25")
