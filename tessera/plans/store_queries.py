"""Queries of the store's operators, joins and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import store
from ..operators import report
from .registry import Tables, query

_OLD = "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0"
_NEW = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 2 = 0"


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.part.select("p_partkey", "p_name", "p_size")
    return p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 2 = 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))


@query("k1_upsert_symbols", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, coalesce(n.p_name, o.p_name) AS p_name, coalesce(n.p_size, o.p_size) AS p_size, CASE WHEN n.p_partkey IS NULL THEN 'kept' WHEN o.p_partkey IS NULL THEN 'added' WHEN o.p_size = n.p_size THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN n USING (p_partkey)")
def upsert_symbols(t: Tables) -> DataFrame:
    return store.upsert(*_old_new(t), ["p_partkey"])


@query("k2_upsert_findings", "WITH o AS (SELECT event_id AS finding_id, md5(event_type) AS fingerprint FROM events WHERE event_id % 4 <> 0), n AS (SELECT event_id AS finding_id, md5(CASE WHEN event_id % 6 = 0 THEN 'x' ELSE event_type END) AS fingerprint FROM events WHERE event_id % 2 = 0) SELECT n.finding_id, n.fingerprint, CASE WHEN o.finding_id IS NULL THEN 'insert' WHEN o.fingerprint = n.fingerprint THEN 'touch' ELSE 'update' END AS action, CASE WHEN o.finding_id IS NULL THEN 'discovery' WHEN o.fingerprint <> n.fingerprint THEN 'fix' END AS event FROM n LEFT JOIN o USING (finding_id)")
def upsert_findings(t: Tables) -> DataFrame:
    mark = lambda c: F.md5(c.cast("binary")).alias("fingerprint")
    old = t.events.where("event_id % 4 <> 0").select(F.col("event_id").alias("finding_id"), mark(F.col("event_type")))
    new = t.events.where("event_id % 2 = 0").select(F.col("event_id").alias("finding_id"), mark(F.when(F.col("event_id") % 6 == 0, "x").otherwise(F.col("event_type"))))
    return store.classify_findings(old, new)


@query("k3_insert_ignore", "SELECT user_id, event_type FROM events WHERE event_id < 2000 UNION ALL (SELECT DISTINCT user_id, event_type FROM events WHERE event_id >= 2000 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id < 2000))")
def insert_ignore(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type")
    return store.insert_ignore(rows.where("event_id < 2000").drop("event_id"), rows.where("event_id >= 2000").drop("event_id"), ["user_id", "event_type"])


@query("k4_delete_cascade", "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_partkey % 7 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 <> 0")
def delete_cascade(t: Tables) -> DataFrame:
    findings = t.orders.select(F.col("o_orderkey").alias("finding_id"))
    gone = findings.where("finding_id % 7 = 0")
    edges = t.lineitem.select(F.lit("finding").alias("src_kind"), F.col("l_orderkey").cast("string").alias("src_id"), F.lit("finding").alias("dst_kind"), F.col("l_partkey").cast("string").alias("dst_id"))
    left, kept = store.delete_cascade(findings, edges, gone)
    return kept.select(F.col("src_id").cast("long").alias("src"), F.col("dst_id").cast("long").alias("dst")).unionByName(left.select(F.col("finding_id").alias("src"), F.lit(None).cast("long").alias("dst")))


@query("j1_facts_join", "SELECT DISTINCT o_orderkey, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_name LIKE 'red%' ORDER BY o_orderpriority, o_orderkey")
def facts_join(t: Tables) -> DataFrame:
    parts = t.part.where(F.col("p_name").startswith("red")).select("p_partkey")
    hit = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey")
    return t.orders.join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey")


@query("j2_semi_in_list", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def semi_in_list(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    a = t.part.where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("a"))
    b = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("b"))
    return rows.join(a, "l_partkey", "left").join(b, "l_suppkey", "left").where("a OR b").select("l_orderkey", "l_partkey", "l_suppkey")


@query("j3_anti_orphans", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_orphans(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("j4_resolve_symbol", "WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS short FROM part), c AS (SELECT short, p_partkey, p_brand, CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE 1 END AS tier, p_size FROM q JOIN part ON split_part(p_name, ' ', 2) = short) SELECT short, p_partkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY short ORDER BY tier, p_size, p_partkey) AS n FROM c) WHERE n = 1")
def resolve_symbol(t: Tables) -> DataFrame:
    """Same file first, then the whole project, then by kind."""
    parts = t.part.withColumn("short", F.element_at(F.split("p_name", " "), 2)).withColumn("tier", F.when(F.col("p_brand") == "Brand#1", 0).otherwise(1))
    wanted = parts.select("short").distinct()
    return store.first_of(parts.join(wanted, "short", "left_semi"), ["short"], [F.col("tier"), F.col("p_size"), F.col("p_partkey")]).select("short", "p_partkey", "tier")


@query("j5_link_findings", "SELECT DISTINCT o_orderkey AS finding, 'found_in' AS relation, l_partkey AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 UNION SELECT DISTINCT o_orderkey, 'affects', l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 1")
def link_findings(t: Tables) -> DataFrame:
    path = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return path.select(F.col("o_orderkey").alias("finding"), F.when(F.col("l_linenumber") == 1, "found_in").otherwise("affects").alias("relation"), F.col("l_partkey").alias("symbol")).distinct()


@query("j15_snapshot_reconcile", "WITH b AS (SELECT DISTINCT substring(md5(text), 1, 10) AS f FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT DISTINCT substring(md5(text), 1, 10) AS f FROM documents WHERE doc_id % 2 = 0) SELECT coalesce(b.f, n.f) AS fingerprint, CASE WHEN b.f IS NULL THEN 'added' WHEN n.f IS NULL THEN 'resolved' ELSE 'unchanged' END AS state FROM b FULL JOIN n ON b.f = n.f")
def snapshot_reconcile(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.substring(F.md5(F.col("text").cast("binary")), 1, 10).alias("fingerprint"))
    return store.reconcile(d.where("doc_id % 3 <> 0"), d.where("doc_id % 2 = 0"), "fingerprint")


@query("j18_vuln_to_node", "SELECT e.event_id, coalesce(a.p_partkey, b.p_partkey) AS node FROM events e LEFT JOIN part a ON a.p_partkey = e.event_id LEFT JOIN part b ON b.p_partkey = e.user_id")
def vuln_to_node(t: Tables) -> DataFrame:
    a, b = (t.part.select(F.col("p_partkey").alias(x)) for x in ("a", "b"))
    return t.events.join(a, F.col("event_id") == F.col("a"), "left").join(b, F.col("user_id") == F.col("b"), "left").select("event_id", F.coalesce("a", "b").alias("node"))


@query("a1_stats_counts", "SELECT event_type AS kind, count(*) AS n, max(ts) AS last FROM events GROUP BY event_type")
def stats_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("a2_rollup_findings", "SELECT l_returnflag AS severity, l_linestatus AS category, l_linenumber AS file, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))")
def rollup_findings(t: Tables) -> DataFrame:
    """Three rollups of deduplicated findings in one pass."""
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("severity"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias("file")).distinct()
    c = [F.col("severity"), F.col("category"), F.col("file")]
    return rows.groupingSets([[x] for x in c], *c).agg(F.count("*").alias("n"))


@query("a3_audit_summary", "SELECT 'finding' AS source, o_orderpriority AS severity, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'chain', event_type, count(*) FROM events GROUP BY 2")
def audit_summary(t: Tables) -> DataFrame:
    f = t.orders.select(F.lit("finding").alias("source"), F.col("o_orderpriority").alias("severity"))
    c = t.events.select(F.lit("chain").alias("source"), F.col("event_type").alias("severity"))
    return f.unionByName(c).groupBy("source", "severity").agg(F.count("*").alias("n"))


@query("a4_confusion_per_class", "WITH e AS (SELECT lang AS class, count(*) AS expected FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1), f AS (SELECT lang AS class, count(*) AS found FROM documents WHERE n_chars < 1200 GROUP BY 1) SELECT class, least(coalesce(expected, 0), coalesce(found, 0)) AS tp, greatest(coalesce(expected, 0) - coalesce(found, 0), 0) AS fn, CASE WHEN expected IS NULL THEN found ELSE 0 END AS fp FROM e FULL JOIN f USING (class)")
def confusion_per_class(t: Tables) -> DataFrame:
    """Expected least counts against found ones; hits of classes that nobody expects are false."""
    expected = t.documents.join(t.labels.where("quality = 0"), "doc_id").groupBy(F.col("lang").alias("class")).agg(F.count("*").alias("expected"))
    found = t.documents.where("n_chars < 1200").groupBy(F.col("lang").alias("class")).agg(F.count("*").alias("found"))
    e, f = F.coalesce("expected", F.lit(0)), F.coalesce("found", F.lit(0))
    return expected.join(found, "class", "full_outer").select("class", F.least(e, f).alias("tp"), F.greatest(e - f, F.lit(0)).alias("fn"), F.when(F.col("expected").isNull(), f).otherwise(0).alias("fp"))


@query("w10_stable_ids", "WITH f AS (SELECT DISTINCT substring(md5(text), 1, 10) AS fingerprint FROM documents), k AS (SELECT fingerprint, format('VULN-2024-{:04d}', row_number() OVER (ORDER BY fingerprint)) AS id FROM f WHERE fingerprint < '4') SELECT f.fingerprint, coalesce(k.id, format('VULN-2025-{:04d}', (SELECT count(*) FROM k) + row_number() OVER (PARTITION BY k.id IS NULL ORDER BY f.fingerprint))) AS id FROM f LEFT JOIN k USING (fingerprint)")
def stable_ids(t: Tables) -> DataFrame:
    f = t.documents.select(F.substring(F.md5(F.col("text").cast("binary")), 1, 10).alias("fingerprint")).distinct()
    known = store.numbered(f.where("fingerprint < '4'"), [F.col("fingerprint")], "_place").withColumn("id", F.format_string("VULN-2024-%04d", "_place")).drop("_place")
    return store.stable_ids(f, known, "VULN", 2025, [F.col("fingerprint")])


@query("l4_facts_caps", "(SELECT 'symbol' AS kind, p_partkey AS id FROM part ORDER BY p_partkey LIMIT 20) UNION ALL (SELECT 'event', event_id FROM events ORDER BY ts DESC, event_id LIMIT 30) UNION ALL (SELECT 'relation', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY l_orderkey LIMIT 100)")
def facts_caps(t: Tables) -> DataFrame:
    one = lambda c: [F.col(c)]
    return report.capped([("symbol", t.part, "p_partkey", 20, one("p_partkey")), ("event", t.events, "event_id", 30, [F.desc("ts"), F.col("event_id")]), ("relation", t.lineitem.select("l_orderkey").distinct(), "l_orderkey", 100, one("l_orderkey"))])


@query("l5_findings_order", "SELECT l_returnflag, l_partkey, l_linenumber, l_orderkey FROM lineitem ORDER BY l_returnflag DESC, l_partkey, l_linenumber, l_orderkey LIMIT 50")
def findings_order(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_partkey", "l_linenumber", "l_orderkey").orderBy(F.desc("l_returnflag"), "l_partkey", "l_linenumber", "l_orderkey").limit(50)


@query("l6_chains_order", "SELECT event_id, event_type, value FROM events ORDER BY event_type DESC, value DESC, event_id LIMIT 50")
def chains_order(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type", "value").orderBy(F.desc("event_type"), F.desc("value"), "event_id").limit(50)


@query("l17_recent_n", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent_n(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(10)


@query("l20_model_pick", "SELECT s_nationkey AS pool, arg_min(s_suppkey, (-s_acctbal, s_suppkey)) AS model FROM supplier GROUP BY 1")
def model_pick(t: Tables) -> DataFrame:
    return t.supplier.groupBy(F.col("s_nationkey").alias("pool")).agg(F.min_by("s_suppkey", F.struct(-F.col("s_acctbal"), "s_suppkey")).alias("model"))


@query("l21_cache_eviction", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 5")
def cache_eviction(t: Tables) -> DataFrame:
    return t.events.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))).where("n <= 5").select("event_id", "user_id")


@query("u1_dedup_first_wins", "SELECT min(doc_id) AS doc_id, md5(text) AS fingerprint FROM documents GROUP BY md5(text)")
def dedup_first_wins(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))


@query("u2_dedup_by_place", "SELECT l_partkey, l_suppkey, l_returnflag, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL")
def dedup_by_place(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.min("l_orderkey").alias("first_order"))


@query("u4_fingerprint", "SELECT doc_id, substring(md5(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || doc_id::VARCHAR), 1, 10) AS fingerprint FROM documents")
def fingerprints(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", store.fingerprint("source", "lang", "doc_id").alias("fingerprint"))


@query("u6_set_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount < 0.02")
def set_difference(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 45").select("l_partkey").subtract(t.lineitem.where("l_discount < 0.02").select("l_partkey"))


@query("u7_union_sources", "SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS event_type FROM orders UNION ALL SELECT event_id, NULL, event_type FROM events")
def union_sources(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).unionByName(t.events.select(F.col("event_id").alias("id"), "event_type"), allowMissingColumns=True)


@query("u8_incremental_skip", "SELECT doc_id FROM documents WHERE (doc_id, md5(text)) NOT IN (SELECT (doc_id, md5(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END)) FROM documents WHERE doc_id % 4 <> 0)")
def incremental_skip(t: Tables) -> DataFrame:
    mark = F.md5(F.col("text").cast("binary")).alias("hash")
    past = t.documents.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).select("doc_id", mark)
    return t.documents.select("doc_id", mark).join(past, ["doc_id", "hash"], "left_anti").select("doc_id")


@query("u11_latest_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id")
def latest_wins(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
