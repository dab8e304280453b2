"""Queries over history: orders are commits, line items the files they touch, customers the authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import history
from .registry import Tables, query

NOW = 1_000_000_000


def commits(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("message"))


def files(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), F.col("l_quantity").alias("insertions"), F.col("l_linenumber").alias("deletions"))


@query("s5_scan_git_log", "SELECT o_orderkey::VARCHAR AS commit, o_custkey::VARCHAR AS author, o_orderpriority AS message FROM orders")
def scan_git_log(t: Tables) -> DataFrame:
    """Delimited log lines into columns; what follows the last delimiter stays whole."""
    lines = t.orders.select(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderpriority").alias("value"))
    part = F.split("value", r"\|", 3)
    return lines.select(part[0].alias("commit"), part[1].alias("author"), part[2].alias("message"))


@query("s6_scan_line_history", "SELECT DISTINCT l_partkey AS file, l_orderkey AS commit FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 3 AND l_linenumber + greatest(l_quantity::INT, 1) - 1 >= 2")
def scan_line_history(t: Tables) -> DataFrame:
    hunks = t.lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("start"), F.col("l_quantity").cast("int").alias("count"))
    ranges = t.part.select(F.col("p_partkey").alias("file"), F.lit(2).alias("first"), F.lit(3).alias("last"))
    return history.overlaps(hunks, ranges, "file").select("file", "commit").distinct()


@query("j16_interval_overlap", "SELECT a.l_orderkey AS file, a.l_linenumber AS hunk, b.l_linenumber AS range FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE b.l_linenumber % 2 = 0 AND a.l_linenumber % 2 = 1 AND a.l_quantity::INT <= b.l_quantity::INT + 10 AND a.l_quantity::INT + greatest(a.l_linenumber, 1) - 1 >= b.l_quantity::INT")
def interval_overlap(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    hunks = t.lineitem.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("hunk"), q.alias("start"), F.col("l_linenumber").alias("count"))
    ranges = t.lineitem.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("range"), q.alias("first"), (q + 10).alias("last"))
    return history.overlaps(hunks, ranges, "file").select("file", "hunk", "range")


@query("a8_hotspots", "WITH r AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS changes FROM lineitem JOIN r ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def hotspots(t: Tables) -> DataFrame:
    return history.hotspots(commits(t), files(t).select("commit", "file"))


@query("a9_recent_activity", "SELECT o_orderdate::DATE AS day, count(DISTINCT o_orderkey) AS commits, count(DISTINCT l_partkey) AS files, sum(l_quantity) AS insertions, sum(l_linenumber)::BIGINT AS deletions FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def recent_activity(t: Tables) -> DataFrame:
    return commits(t).join(files(t), "commit").groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("commit").alias("commits"), F.count_distinct("file").alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


@query("a10_contributor_stats", "SELECT o_custkey AS author, count(*) AS commits FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def contributor_stats(t: Tables) -> DataFrame:
    return commits(t).groupBy("author").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author").limit(10)


@query("a11_changelog", "SELECT CASE WHEN regexp_matches(lower(event_type), 'feat|add|signup') THEN 'feat' WHEN regexp_matches(lower(event_type), 'fix|bug|error') THEN 'fix' ELSE 'other' END AS class, count(*) AS n, list(event_id ORDER BY ts DESC, event_id)[1:5] AS newest FROM events GROUP BY 1")
def changelog(t: Tables) -> DataFrame:
    rows = t.events.withColumn("class", history.change_class(F.col("event_type")))
    n = rows.groupBy("class").agg(F.count("*").alias("n"))
    top = rows.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("ts"), "event_id"))).where("k <= 5").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("k", "event_id"))).alias("x"))
    return n.join(top, "class").select("class", "n", F.col("x.event_id").alias("newest"))


@query("a12_genesis", "SELECT o_custkey AS file, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_commit, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_commit, count(*) AS commits, floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400)::BIGINT AS age_days FROM orders GROUP BY 1")
def genesis(t: Tables) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy(F.col("o_custkey").alias("file")).agg(F.min_by("o_orderkey", at).alias("first_commit"), F.max_by("o_orderkey", at).alias("last_commit"), F.count("*").alias("commits"), F.floor((F.unix_timestamp(F.max("o_orderdate")) - F.unix_timestamp(F.min("o_orderdate"))) / 86400).alias("age_days"))


@query("a13_co_evolution", "WITH f AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), n AS (SELECT f, count(*) AS n FROM f GROUP BY f HAVING count(*) >= 2), p AS (SELECT a.f AS a, b.f AS b, count(*) AS shared FROM f a JOIN f b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a, b, shared, x.n - shared AS only_a, y.n - shared AS only_b, round(shared / (x.n + y.n - shared), 3) AS jaccard, CASE WHEN round(shared / (x.n + y.n - shared), 3) >= 0.7 THEN 'strong' WHEN round(shared / (x.n + y.n - shared), 3) >= 0.35 THEN 'moderate' ELSE 'weak' END AS strength FROM p JOIN n x ON a = x.f JOIN n y ON b = y.f")
def co_evolution(t: Tables) -> DataFrame:
    return history.co_evolution(files(t).select("commit", "file"))


_STABLE = f"WITH g AS (SELECT o_custkey AS file, count(*) AS changes, greatest(1, floor(({NOW} - min(epoch(o_orderdate))) / 86400))::BIGINT AS age_days, greatest(0, floor(({NOW} - max(epoch(o_orderdate))) / 86400))::BIGINT AS quiet_days FROM orders WHERE o_orderdate < TIMESTAMP '2001-09-09' GROUP BY 1), s AS (SELECT *, greatest(0, least(100, round_even(100 - least(100, changes / age_days * 30 * 10) + least(30, quiet_days / 30 * 5), 0)::INT)) AS score FROM g)"


@query("a14_stability", _STABLE + " SELECT file, age_days, changes, round(changes / age_days * 30, 2) AS monthly, quiet_days, score, CASE WHEN score >= 80 THEN 'very stable' WHEN score >= 60 THEN 'moderately stable' WHEN score >= 40 THEN 'active' WHEN score >= 20 THEN 'volatile' ELSE 'extremely volatile' END AS label FROM s")
def stability(t: Tables) -> DataFrame:
    return history.stability(t.orders.where("o_orderdate < TIMESTAMP '2001-09-09'").select(F.col("o_custkey").alias("file"), F.unix_timestamp("o_orderdate").alias("epoch")), NOW)


_BUS = "WITH c AS (SELECT c_nationkey AS file, o_custkey AS author, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS rank FROM c)"


@query("a15_bus_factor", _BUS + " SELECT file, min(rank) AS bus_factor FROM r WHERE upto >= total * 0.8 GROUP BY file")
def bus_factor(t: Tables) -> DataFrame:
    counts = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("file"), F.col("o_custkey").alias("author")).agg(F.count("*").alias("commits"))
    return history.bus_factor(counts, ["file"])


@query("a16_fn_history", "SELECT l_orderkey AS commit, sum(l_quantity) AS added, sum(l_linenumber)::BIGINT AS removed FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def fn_history(t: Tables) -> DataFrame:
    return files(t).groupBy("commit").agg(F.sum("insertions").alias("added"), F.sum("deletions").alias("removed")).orderBy(F.desc("commit")).limit(20)


@query("m1_file_history", "SELECT DISTINCT o_orderkey AS commit, o_orderdate AS ts FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 42 ORDER BY 2 DESC, 1 LIMIT 20")
def file_history(t: Tables) -> DataFrame:
    return commits(t).join(files(t).where("file = 42").select("commit").distinct(), "commit", "left_semi").select("commit", "ts").orderBy(F.desc("ts"), "commit").limit(20)


@query("m5_full_report", "WITH f AS (SELECT l_partkey AS file, l_orderkey AS c, o_custkey AS a, o_orderdate AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT file, count(DISTINCT c) AS commits, count(DISTINCT a) AS authors, min(d) AS first_change, max(d) AS last_change FROM f GROUP BY file")
def full_report(t: Tables) -> DataFrame:
    return files(t).join(commits(t), "commit").groupBy("file").agg(F.count_distinct("commit").alias("commits"), F.count_distinct("author").alias("authors"), F.min("ts").alias("first_change"), F.max("ts").alias("last_change"))


_WORDS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("t28_suspicion_score", f"WITH d AS (SELECT doc_id, lower(text) AS m, [lower(source) || '.yml', lang] AS files, n_chars // 20 AS ch FROM documents), w AS (SELECT *, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(m, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')), ['the', 'error', 'of'])) AS ov FROM d), s AS (SELECT *, least(ov * 0.15, 0.45) + len(list_filter(files, lambda f: len(list_filter(['src1', 'en'], lambda h: contains(f, h))) > 0)) * 0.2 + CASE WHEN ch > 100 THEN 0.15 WHEN ch > 50 THEN 0.10 WHEN ch > 20 THEN 0.05 ELSE 0 END + CASE WHEN len(list_filter({_WORDS(history.RISKY)}, lambda h: contains(m, h))) > 0 THEN 0.15 ELSE 0 END + 0.05 AS sc FROM w) SELECT doc_id, round(least(CASE WHEN len(list_filter({_WORDS(history.TRIVIAL)}, lambda h: contains(m, h))) > 0 AND ch < 20 THEN sc * 0.3 ELSE sc END, 1.0), 6) AS suspicion FROM s")
def suspicion_score(t: Tables) -> DataFrame:
    d = t.documents.withColumn("files", F.array(F.concat(F.lower("source"), F.lit(".yml")), "lang"))
    return d.select("doc_id", F.round(history.suspicion(F.col("text"), F.col("files"), F.floor(F.col("n_chars") / 20), "the error of", ("src1", "en")), 6).alias("suspicion"))


@query("l14_suspects", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def suspects(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)
