"""Graph queries: edges run from suppliers to parts, or by arithmetic over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators import report
from .registry import Tables, query

_EDGES = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2)"


def edges(t: Tables) -> DataFrame:
    half = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    third = t.part.where("p_partkey > 2").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst"))
    return half.union(third).distinct()


def nodes(t: Tables, *ids: int) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "node long")


@query("j8_neighbors", "SELECT l_suppkey AS node, 'out' AS side, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_partkey, 'in', count(DISTINCT l_suppkey) FROM lineitem GROUP BY 1")
def neighbors(t: Tables) -> DataFrame:
    e = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    out = e.groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("n")).withColumn("side", F.lit("out"))
    return out.unionByName(e.groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("n")).withColumn("side", F.lit("in")))


@query("j9_impact_bfs", f"WITH RECURSIVE {_EDGES}, r AS (SELECT 5::BIGINT AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def impact_bfs(t: Tables) -> DataFrame:
    """Who depends on a node: the default of three hops emits distances up to four."""
    return graph.distances(edges(t), nodes(t, 5), 3 + 1, reverse=True)


@query("j10_call_chain_bfs", f"WITH RECURSIVE {_EDGES}, r AS (SELECT 777::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 5) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def call_chain_bfs(t: Tables) -> DataFrame:
    return graph.distances(edges(t), nodes(t, 777), 5)


_PATHS = "WITH RECURSIVE {e}, p AS (SELECT s AS start, s AS last, [s] AS path FROM (VALUES {starts}) v(s) UNION ALL SELECT start, e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.last WHERE len(path) < {n} AND NOT list_contains(path, e.dst)) SELECT start, last AS \"end\", path FROM (SELECT *, row_number() OVER (PARTITION BY start, last ORDER BY len(path), path) AS k FROM p WHERE last IN ({ends}) AND len(path) > 1) WHERE k = 1"


@query("j11_taint_paths", _PATHS.format(e=_EDGES, starts="(700::BIGINT), (701), (1500)", n=5, ends="58, 77, 21, 43, 93"))
def taint_paths(t: Tables) -> DataFrame:
    return graph.paths(edges(t), nodes(t, 700, 701, 1500), nodes(t, 58, 77, 21, 43, 93), 4)


@query("j12_attack_chains", _PATHS.format(e=_EDGES, starts="(1999::BIGINT), (1024)", n=5, ends="SELECT p_partkey FROM part WHERE p_size > 30"))
def attack_chains(t: Tables) -> DataFrame:
    return graph.paths(edges(t), nodes(t, 1999, 1024), t.part.where("p_size > 30").select(F.col("p_partkey").alias("node")), 4)


@query("j13_import_reachability", f"WITH RECURSIVE {_EDGES}, r AS (SELECT 1000::BIGINT AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r WHERE node <> 1000")
def import_reachability(t: Tables) -> DataFrame:
    return graph.distances(edges(t), nodes(t, 1000), 11).where("depth > 0").select("node")


@query("j14_neighbor_scope", f"WITH RECURSIVE {_EDGES}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT 60::BIGINT AS node, 0 AS depth UNION SELECT u.b, r.depth + 1 FROM r JOIN u ON u.a = r.node WHERE r.depth < 2) SELECT node FROM (SELECT node, min(depth) AS depth FROM r GROUP BY node) ORDER BY depth, node LIMIT 25")
def neighbor_scope(t: Tables) -> DataFrame:
    e = edges(t)
    both = e.union(e.select("dst", "src"))
    return graph.distances(both, nodes(t, 60), 2).orderBy("depth", "node").limit(25).select("node")


@query("j17_graph_retriever", f"WITH {_EDGES}, d AS (SELECT p_partkey AS node, CASE WHEN p_name = 'red ring' THEN 1.0 WHEN p_name LIKE '% ring' THEN 0.9 END AS score FROM part WHERE p_name LIKE '% ring'), n AS (SELECT e.dst AS node, 0.5 AS score FROM e JOIN d ON e.src = d.node UNION ALL SELECT e.src, 0.5 FROM e JOIN d ON e.dst = d.node) SELECT node, max(score)::DOUBLE AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM n) GROUP BY node ORDER BY 2 DESC, 1 LIMIT 15")
def graph_retriever(t: Tables) -> DataFrame:
    """Names score 1, suffixes 0.9, one-hop neighbours 0.5; the best score of a node counts."""
    e = edges(t)
    d = t.part.where(F.col("p_name").endswith(" ring")).select(F.col("p_partkey").alias("node"), F.when(F.col("p_name") == "red ring", 1.0).otherwise(0.9).alias("score"))
    near = e.join(d, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node"), F.lit(0.5).alias("score"))
    back = e.join(d, F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node"), F.lit(0.5).alias("score"))
    return d.unionByName(near).unionByName(back).groupBy("node").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node").limit(15)


@query("j20_dead_code", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND NOT regexp_matches(p_name, 'test|main') ORDER BY p_size DESC, p_partkey LIMIT 200")
def dead_code(t: Tables) -> DataFrame:
    used = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return report.dead(t.part, "p_partkey", "p_name", used, "test|main", [F.desc("p_size"), F.col("p_partkey")], 200).select("p_partkey", "p_name", "p_size")


@query("l7_dead_code_order", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice DESC, p_brand, p_partkey LIMIT 30")
def dead_code_order(t: Tables) -> DataFrame:
    return t.part.orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_brand", "p_partkey").limit(30).select("p_partkey")


@query("m17_function_context", "SELECT l_suppkey AS f, list(DISTINCT l_partkey ORDER BY l_partkey) AS callees FROM lineitem GROUP BY 1")
def function_context(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("f")).agg(F.array_sort(F.collect_set("l_partkey")).alias("callees"))


@query("m42_callers_and_callees", f"WITH {_EDGES} SELECT 'callee' AS side, dst AS node FROM e WHERE src = 120 UNION ALL SELECT 'caller', src FROM e WHERE dst = 120")
def callers_and_callees(t: Tables) -> DataFrame:
    e = edges(t)
    return e.where("src = 120").select(F.lit("callee").alias("side"), F.col("dst").alias("node")).unionByName(e.where("dst = 120").select(F.lit("caller").alias("side"), F.col("src").alias("node")))


@query("m3_resolve_function", "SELECT p_partkey, p_name, CASE WHEN p_name = 'red ring' THEN 'exact' ELSE 'suffix' END AS how FROM part WHERE p_name = 'red ring' OR p_name LIKE '% ring'")
def resolve_function(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").endswith(" ring")).select("p_partkey", "p_name", F.when(F.col("p_name") == "red ring", "exact").otherwise("suffix").alias("how"))
