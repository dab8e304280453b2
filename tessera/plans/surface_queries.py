"""Readers, sinks, the language's parts and streams, run over files that are made of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assist
from ..operators.store import dropped_later, shared_folder
from ..sources import readers, sinks
from ..streaming import state, watch
from . import dsl
from .registry import Tables, query


def scratch(t: Tables, name: str) -> str:
    """A new folder in the shared one, which goes when the process ends."""
    return dropped_later(t.spark, f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}")


@query("s2_scan_json_files", "SELECT n_nationkey, n_name FROM nation")
def scan_json_files(t: Tables) -> DataFrame:
    """One object a file."""
    at = scratch(t, "json")
    t.nation.select("n_nationkey", "n_name").write.option("maxRecordsPerFile", 1).json(at)
    return readers.json_files(t.spark, f"{at}/*.json", "n_nationkey int, n_name string")


@query("s3_scan_json_lines", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 10 <> 0")
def scan_json_lines(t: Tables) -> DataFrame:
    """Every tenth line is broken and dropped."""
    at = scratch(t, "lines")
    whole = F.to_json(F.struct("p_partkey", "p_name"))
    sinks.write_lines(t.part, F.when(F.col("p_partkey") % 10 == 0, F.substring(whole, 1, 12)).otherwise(whole), at)
    return readers.json_lines(t.spark, at, "p_partkey long, p_name string")


@query("s4_scan_files", "SELECT n_regionkey AS folder, sum(strlen(n_name) + 1)::BIGINT AS bytes, string_agg(n_name || chr(10), '' ORDER BY n_name) AS text FROM nation WHERE n_regionkey <> 3 GROUP BY 1")
def scan_files(t: Tables) -> DataFrame:
    """A tree of a folder a region, of which an ignore pattern takes one."""
    at = scratch(t, "tree")
    t.nation.repartition(1).sortWithinPartitions("n_regionkey", "n_name").select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(at)
    files = readers.source_tree(t.spark, at, ("txt",), ignore=[readers.ignore_pattern("/n_regionkey=3/")])
    return files.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("folder"), F.col("length").alias("bytes"), "text")


@query("m32_ignore_patterns", "SELECT doc_id, contains(p, 'src1') OR ends_with(p, '.log') AS ignored FROM (SELECT doc_id, coalesce(source, '') || '/f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.log' ELSE '.py' END AS p FROM documents)")
def ignore_patterns(t: Tables) -> DataFrame:
    lines = ["# made", "", "/src1/", "!src1/kept", "*.log"]
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/f"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".log").otherwise(".py"))
    return t.documents.select("doc_id", readers.ignored(path, [p for p in map(readers.ignore_pattern, lines) if p]).alias("ignored"))


@query("k5_truncate_all", "SELECT (SELECT count(*) FROM nation) AS before, 0::BIGINT AS after")
def truncate_all(t: Tables) -> DataFrame:
    at = scratch(t, "truncated")
    before = sinks.save_snapshot(t.nation, at).count()
    sinks.truncate(t.spark, at)
    left = sinks.load_snapshot(t.spark, at)
    return t.spark.range(1).select(F.lit(before).cast("long").alias("before"), F.lit(0 if left is None else left.count()).cast("long").alias("after"))


@query("k14_persist_findings", "SELECT doc_id::VARCHAR AS finding_id, lang FROM documents")
def persist_findings(t: Tables) -> DataFrame:
    at = scratch(t, "findings")
    sinks.persist_findings(t.documents.select(F.col("doc_id").cast("string").alias("finding_id"), "lang"), "finding_id", at)
    return readers.json_lines(t.spark, at, "finding_id string, lang string").select("finding_id", "lang")


@query("k15_save_state", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def save_state(t: Tables) -> DataFrame:
    at = scratch(t, "state")
    sinks.save_updates(t.nation.select("n_nationkey", "n_name"), at, ["n_nationkey"])
    sinks.save_updates(t.nation.where("n_nationkey < 5").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name")), at, ["n_nationkey"])
    return sinks.load_snapshot(t.spark, at)


def asked(t: Tables) -> DataFrame:
    """(p_partkey, text): a query for every part, some of them broken, with what the part says in it."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    texts = (
        F.concat(F.lit("findings where severity >= high and file ~ '"), name, F.lit("' limit "), size),
        F.concat(F.lit("Symbols where complexity > -"), size, F.lit('.5 and Name = "'), name, F.lit('"')),
        F.concat(F.lit("events where since = "), size, F.lit("d and kind != error or 2024-01-05 limit 3")),
        F.concat(F.lit("nothing where x = "), k),
        F.concat(F.lit("symbols where name "), k),
    )
    return t.part.select("p_partkey", F.element_at(F.array(*texts), (k % 5 + 1).cast("int")).alias("text"))


@query("f1_dsl_tokenize", "WITH v AS (SELECT * FROM (VALUES (0, 0, 'word', 'findings'), (0, 1, 'word', 'where'), (0, 2, 'word', 'severity'), (0, 3, 'op', '>='), (0, 4, 'word', 'high'), (0, 5, 'word', 'and'), (0, 6, 'word', 'file'), (0, 7, 'op', '~'), (0, 8, 'quoted', '@'), (0, 9, 'word', 'limit'), (0, 10, 'number', '#'), (1, 0, 'word', 'Symbols'), (1, 1, 'word', 'where'), (1, 2, 'word', 'complexity'), (1, 3, 'op', '>'), (1, 4, 'number', '-#.5'), (1, 5, 'word', 'and'), (1, 6, 'word', 'Name'), (1, 7, 'op', '='), (1, 8, 'quoted', '@'), (2, 0, 'word', 'events'), (2, 1, 'word', 'where'), (2, 2, 'word', 'since'), (2, 3, 'op', '='), (2, 4, 'span', '#d'), (2, 5, 'word', 'and'), (2, 6, 'word', 'kind'), (2, 7, 'op', '!='), (2, 8, 'word', 'error'), (2, 9, 'word', 'or'), (2, 10, 'date', '2024-01-05'), (2, 11, 'word', 'limit'), (2, 12, 'number', '3'), (3, 0, 'word', 'nothing'), (3, 1, 'word', 'where'), (3, 2, 'word', 'x'), (3, 3, 'op', '='), (3, 4, 'number', '%'), (4, 0, 'word', 'symbols'), (4, 1, 'word', 'where'), (4, 2, 'word', 'name'), (4, 3, 'number', '%')) AS v(q, place, kind, value)) SELECT p_partkey, place::INT AS place, kind, replace(replace(replace(value, '@', p_name), '#', p_size::VARCHAR), '%', p_partkey::VARCHAR) AS value FROM part JOIN v ON p_partkey % 5 = q")
def dsl_tokenize(t: Tables) -> DataFrame:
    return dsl.tokens(asked(t), "p_partkey", "text")


@query("f2_dsl_parse", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'findings' WHEN 1 THEN 'symbols' WHEN 2 THEN 'events' END AS entity, CASE p_partkey % 5 WHEN 0 THEN 'severity >= high, file ~ ' || p_name WHEN 1 THEN 'complexity > -' || p_size || '.5, name = ' || p_name WHEN 2 THEN 'since = ' || p_size || 'd, kind != error' ELSE '' END AS predicates, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN 100 WHEN 2 THEN 3 END::INT AS most, CASE p_partkey % 5 WHEN 3 THEN 'unknown entity' WHEN 4 THEN 'an operator is missing' END AS error FROM part")
def dsl_parse(t: Tables) -> DataFrame:
    said = F.array_join(F.transform("predicates", lambda p: F.concat_ws(" ", p["name"], p["op"], p["value"])), ", ")
    return dsl.queries(asked(t), "p_partkey", "text").select("p_partkey", "entity", said.alias("predicates"), "most", F.regexp_extract("error", "^(unknown entity|an operator is missing)", 1).alias("error"))


@query("f10_nl_to_dsl_model", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'events where kind = error limit ' || p_size WHEN 1 THEN CASE WHEN contains(p_name, 'new') THEN 'findings where since = 1d limit 50' ELSE 'findings limit 20' END ELSE 'symbols limit ' || p_partkey END AS found FROM part")
def nl_to_dsl_model(t: Tables) -> DataFrame:
    """A model's answer counts without its code fence, and only if it parses; else the keywords of the question do."""
    said = F.element_at(F.array(F.concat(F.lit("```sql\nevents where kind = error limit "), "p_size", F.lit("\n```")), F.concat(F.lit("no idea: "), "p_name"), F.concat(F.lit("\n\n symbols limit "), "p_partkey", F.lit("\nsymbols"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return dsl.routed(t.part.select("p_partkey", F.concat(F.lit("show any "), "p_name").alias("question"), said.alias("said")), "p_partkey", "question", "said")


@query("f11_query_router", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'symbols where line > ' || p_size WHEN 1 THEN 'symbols where ' || CASE WHEN contains(p_name, 'new') THEN 'since = 1d and ' ELSE '' END || 'kind = function and complexity > 10 limit 50' WHEN 2 THEN 'findings where severity = HIGH and category = sql_injection and since = ' || CASE WHEN contains(p_name, 'new') THEN '1d' ELSE '7d' END || ' limit 50' WHEN 3 THEN CASE WHEN contains(p_name, 'new') THEN 'findings where since = 1d limit 50' WHEN contains(p_name, 'small') THEN 'findings limit 20' END ELSE 'events where ' || CASE WHEN contains(p_name, 'new') THEN 'since = 1d and ' ELSE '' END || 'source = brain limit 50' END AS found FROM part")
def query_router(t: Tables) -> DataFrame:
    """Queries pass, questions are translated by their keywords, the rest gives nothing."""
    texts = (F.concat(F.lit("symbols where line > "), "p_size"), F.concat(F.lit("Complex functions about "), "p_name"), F.concat(F.lit("high sql problems of this week, "), "p_name"), F.concat(F.lit("zzz "), "p_name"), F.concat(F.lit("the timeline by brain and "), "p_name"))
    return dsl.routed(t.part.select("p_partkey", F.element_at(F.array(*texts), (F.col("p_partkey") % 5 + 1).cast("int")).alias("text")), "p_partkey", "text")


@query("m2_git_context", "WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations), s AS (SELECT conv_id, turn, q, list_filter([CASE WHEN regexp_matches(q, 'recent|today|week|yesterday|last') THEN 'recent' END, CASE WHEN regexp_matches(q, 'why|changed|modify|history') AND len(list_filter(regexp_split_to_array(q, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: contains(w, '.') AND NOT starts_with(w, '.'))) > 0 THEN 'file' END, CASE WHEN regexp_matches(q, 'hotspot|frequent|most changed') THEN 'hotspots' END, CASE WHEN regexp_matches(q, 'commit|staged|changes') THEN 'commit' END], lambda x: x IS NOT NULL) AS s FROM q) SELECT conv_id, turn, CASE WHEN len(s) = 0 THEN ['recent'] ELSE s END AS sections, CASE WHEN regexp_matches(q, 'today|yesterday') THEN 1 ELSE 7 END AS days FROM s")
def git_context(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", assist.history_sections(F.col("text")).alias("sections"), assist.recent_days(F.col("text")).alias("days"))


@query("m4_function_range", "SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'A.f' ELSE 'g' END AS name, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 5 END::INT AS first, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 6 END::INT AS last FROM part WHERE p_partkey % 5 <> 0")
def function_range(t: Tables) -> DataFrame:
    """Every fifth name is of no function."""
    name = F.when(F.col("p_partkey") % 5 == 0, "h").when(F.col("p_partkey") % 2 == 0, "A.f").otherwise("g")
    files = t.part.select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.lit("class A:\n    def f(self):\n        return 1\n\ndef g(x):\n    return x\n").alias("text"), name.alias("name"))
    return readers.function_ranges(files, "path", "text", "name")


@query("m7_stale_index", "SELECT (SELECT max(CASE WHEN len(embedding) <> 64 THEN 1 ELSE 0 END) FROM embeddings) = 1 OR ((SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang = 'en') > 0 AND (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang = 'en' AND contains(text, '# chunk:')) = 0) AS stale")
def stale_index(t: Tables) -> DataFrame:
    chunks = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id"), "left")
    return assist.stale(chunks.select(F.col("embedding").alias("vec"), F.when(F.col("lang") == "en", "python").alias("language"), "text"), 64, "# chunk:")


@query("m18_tool_gather", "SELECT p_partkey AS question, n_nationkey, n_name AS name FROM part JOIN nation ON n_nationkey = p_partkey % 40")
def tool_gather(t: Tables) -> DataFrame:
    """Questions of which some name something that is known."""
    names = t.nation.select("n_nationkey", F.col("n_name").alias("name"))
    q = t.part.join(names.withColumnRenamed("name", "asked"), F.col("p_partkey") % 40 == F.col("n_nationkey"), "left").select(F.col("p_partkey").alias("question"), F.concat(F.lit("How is it? Explain "), F.coalesce("asked", F.lit("nothing_known"))).alias("text"))
    return assist.gather(q, "question", "text", names)


@query("m22_answer_about_user", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Your name is ' || c_name || '.' WHEN 1 THEN 'You work as ' || c_mktsegment || '.' END AS answer FROM customer")
def answer_about_user(t: Tables) -> DataFrame:
    asked = F.when(F.col("c_custkey") % 4 == 0, "Hey, who am I?").when(F.col("c_custkey") % 4 == 1, "What do I do?").when(F.col("c_custkey") % 4 == 2, "Where am I?").otherwise("How are you?")
    return t.customer.select("c_custkey", assist.answer_about_user(asked, {"name": F.col("c_name"), "location": F.lit(None).cast("string"), "job": F.col("c_mktsegment")}).alias("answer"))


@query("m22_learn_fact", "SELECT DISTINCT 'fact_' || substring(md5(f), 1, 10) AS id, substring(f, 1, 60) AS name, 'fact' AS entity_type, f AS full_text, 0.9::DOUBLE AS confidence FROM (SELECT trim('I like ' || p_name || ' ') AS f FROM part)")
def learn_fact(t: Tables) -> DataFrame:
    return assist.learn(t.part.select(F.concat(F.lit("I like "), "p_name", F.lit(" ")).alias("f")), "f")


def _changes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts as they were and then as they are; some rows of no use."""
    old = t.part.where("p_partkey % 3 = 0").select("p_partkey", F.lit("old").alias("p_name"))
    return old, t.part.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("p_name"))


def _watched(t: Tables) -> tuple[watch.Watcher, DataFrame]:
    old, new = _changes(t)
    at, seen = scratch(t, "watched"), scratch(t, "changes")
    sinks.save_snapshot(old, at)
    watcher = watch.Watcher(at, "p_partkey", sound=F.col("p_name").isNotNull())
    new.where("p_partkey % 2 = 0").write.parquet(seen)
    stream = t.spark.readStream.schema(new.schema).parquet(seen)
    watcher.start(stream, scratch(t, "checkpoint"), once=True).awaitTermination()
    watcher.pause()
    new.where("p_partkey % 2 = 1").write.mode("append").parquet(seen)  # comes while it pauses
    watcher.resume().awaitTermination()
    return watcher, watcher.snapshot(t.spark)


@query("x5_micro_batches", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE p_name END AS p_name FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 3 = 0")
def micro_batches(t: Tables) -> DataFrame:
    """The snapshot after a stream that paused and went on; rows without a name are left out."""
    return _watched(t)[1]


@query("x6_failure_isolation", "SELECT count(*) FILTER (WHERE p_partkey % 7 = 0) AS errors, count(*) FILTER (WHERE p_partkey % 7 <> 0 AND p_partkey % 3 <> 0) AS added, count(*) FILTER (WHERE p_partkey % 7 <> 0 AND p_partkey % 3 = 0) AS updated FROM part")
def failure_isolation(t: Tables) -> DataFrame:
    s = _watched(t)[0].status()
    return t.spark.range(1).select(*(F.lit(s[k]).cast("long").alias(k) for k in ("errors", "added", "updated")))


@query("x7_watcher_status", "SELECT false AS running, true AS paused, 2::BIGINT AS batches")
def watcher_status(t: Tables) -> DataFrame:
    s = _watched(t)[0].status()
    return t.spark.range(1).select(F.lit(s["running"]).alias("running"), F.lit(s["paused"]).alias("paused"), F.lit(s["batches"]).cast("long").alias("batches"))


@query("x11_router_state", "WITH RECURSIVE e AS (SELECT r_name AS tier, c_custkey AS seq, 0.5 + (c_custkey % 50) / 100 AS x, abs(c_acctbal) AS y, row_number() OVER (PARTITION BY r_name ORDER BY c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), f AS (SELECT tier, 0::BIGINT AS k, 0.5::DOUBLE AS c, 1000.0::DOUBLE AS l FROM (SELECT DISTINCT tier FROM e) UNION ALL SELECT e.tier, e.k, 0.1 * e.x + 0.9 * f.c, 0.1 * e.y + 0.9 * f.l FROM f JOIN e ON e.tier = f.tier AND e.k = f.k + 1) SELECT tier, max(k) AS queries, round(arg_max(c, k), 6) AS confidence, round(arg_max(l, k), 4) AS latency FROM f GROUP BY tier")
def router_state(t: Tables) -> DataFrame:
    """A stateful stream over the feedback of all customers; the last row of each tier."""
    at, out = scratch(t, "feedback"), scratch(t, "states")
    tiers = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("tier"))
    rows = t.customer.join(tiers, F.col("c_nationkey") == F.col("n_nationkey")).select("tier", F.col("c_custkey").alias("seq"), (F.lit(0.5) + F.col("c_custkey") % 50 / 100).alias("confidence"), F.abs("c_acctbal").alias("latency"))
    rows.coalesce(1).write.parquet(at)
    stream = state.router_state(t.spark.readStream.schema(rows.schema).parquet(at))
    stream.writeStream.outputMode("update").option("checkpointLocation", scratch(t, "checkpoint")).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    last = t.spark.read.parquet(out).groupBy("tier").agg(F.max_by(F.struct("queries", "confidence", "latency"), "batch").alias("s"))
    return last.select("tier", "s.queries", F.round("s.confidence", 6).alias("confidence"), F.round("s.latency", 4).alias("latency"))
