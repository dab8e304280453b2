"""Smaller operators, readers over made sources, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.store import upsert
from ..sources import readers
from ..operators import assist, report, series
from ..operators import registry as versions
from .registry import Tables, query


@query("s7_scan_diff", "SELECT p_partkey, 'f.py' AS file, 1::INT AS old_start, 2::INT AS old_count, p_size::INT AS new_start, 3::INT AS new_count, 2::INT AS added, 1::INT AS removed FROM part")
def scan_diff(t: Tables) -> DataFrame:
    diff = F.concat(F.lit("--- a/f.py\n+++ b/f.py\n@@ -1,2 +"), F.col("p_size"), F.lit(",3 @@\n a\n-b\n+c\n+d\n"))
    return readers.diff_hunks(t.part.select("p_partkey", diff.alias("diff")), "p_partkey", "diff")


_NUMBERS = "p AS (SELECT p_partkey, (p_partkey * 7 + p_size) % 998 + 2 AS x, (p_partkey * 13) % 998 + 2 AS y, p_partkey % 8 AS k, p_partkey % 49 + 2 AS w, p_size % 49 + 2 AS h, p_size % 20 + 1 AS r FROM part)"
_PROBLEM = "CASE k WHEN 0 THEN 'What is ' || x || ' + ' || y || '?' WHEN 1 THEN 'What is ' || x || ' - ' || y || '?' WHEN 2 THEN 'What is ' || x || ' * ' || y || '?' WHEN 3 THEN 'What is ' || w || '% of ' || y || '?' WHEN 4 THEN 'What is the area of a rectangle with width ' || w || ' and height ' || h || '?' WHEN 5 THEN 'What is the area of a circle with radius ' || r || '?' WHEN 6 THEN 'What is the area of a triangle with base ' || w || ' and height ' || h || '?' ELSE 'Is ' || x || ' a prime number?' END"
_SOLUTION = "CASE k WHEN 0 THEN 'The answer is ' || (x + y) || '.' || n || n || 'Step by step:' || n || x || ' + ' || y || ' = ' || (x + y) WHEN 1 THEN 'The answer is ' || (x - y) || '.' || n || n || 'Step by step:' || n || x || ' - ' || y || ' = ' || (x - y) WHEN 2 THEN 'The answer is ' || (x * y) || '.' || n || n || 'Step by step:' || n || x || ' * ' || y || ' = ' || (x * y) WHEN 3 THEN 'The answer is ' || (y * w / 100.0::DOUBLE) || '.' || n || n || w || '% of ' || y || ' = (' || w || '/100) × ' || y || ' = ' || (y * w / 100.0::DOUBLE) WHEN 4 THEN 'Area = width × height = ' || w || ' × ' || h || ' = ' || (w * h) || ' square units.' WHEN 5 THEN 'Area = π × r² = π × ' || r || '² = π × ' || (r * r) || ' ≈ ' || round(pi() * r * r, 4) || ' square units.' WHEN 6 THEN 'Area = (base × height) / 2 = (' || w || ' × ' || h || ') / 2 = ' || (w * h) || ' / 2 = ' || (w * h / 2.0::DOUBLE) || ' square units.' ELSE x || CASE WHEN len(list_filter(range(2, x), lambda d: x % d = 0)) = 0 THEN ' is prime.' ELSE ' is not prime.' END END"


@query("s11_generate_pairs", f"WITH {_NUMBERS}, q AS (SELECT *, chr(10) AS n, {_PROBLEM} AS problem FROM p) SELECT p_partkey, ['add', 'subtract', 'multiply', 'percentage', 'rectangle', 'circle', 'triangle', 'prime'][k + 1] AS domain, problem, {_SOLUTION} AS solution, CASE WHEN k < 3 THEN least(1.0, greatest(x, y) / 1000.0) WHEN k = 3 THEN 0.3 ELSE 0.4 END::DOUBLE AS difficulty, substring(md5(problem), 1, 12) AS id FROM q")
def generate_pairs(t: Tables) -> DataFrame:
    """A problem of one of eight domains for every part, with numbers from its key and size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    n = k % len(readers.DOMAINS)
    a = F.when(n.isin(0, 1, 2, 7), (k * 7 + size) % 998 + 2).when(n == 5, size % 20 + 1).otherwise(k % 49 + 2)
    b = F.when(n < 4, (k * 13) % 998 + 2).otherwise(size % 49 + 2)
    domain = F.element_at(x.literal(list(readers.DOMAINS)), (n + 1).cast("int"))
    rows = t.part.select("p_partkey", domain.alias("domain"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    return readers.generated_pairs(rows, "p_partkey", "domain", F.col("a"), F.col("b"))


@query("s13_git_status", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'untracked' WHEN 1 THEN 'staged' ELSE 'modified' END AS state, count(*) AS n FROM part GROUP BY 1")
def git_status(t: Tables) -> DataFrame:
    code = F.element_at(F.array(F.lit("?? "), F.lit("M  "), F.lit(" M ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return readers.git_status(t.part.select(F.concat(code, "p_name").alias("value"))).groupBy("state").agg(F.count("*").alias("n"))


@query("s14_symbol_history", "SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 42 AND l_returnflag = 'R' GROUP BY o_orderkey, o_orderdate ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def symbol_history(t: Tables) -> DataFrame:
    hit = t.lineitem.where("l_partkey = 42 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(hit, "o_orderkey", "left_semi").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey")


def _rows_sql(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query("t54_edge_cases", f"SELECT 'f' || p_partkey AS name, ['numeric', 'string', 'list', 'dict', 'other'][p_partkey % 5 + 1] AS kind, value, category, 'f' || p_partkey || '(' || value || ')' AS call FROM part JOIN (VALUES {_rows_sql([(k, *r) for k, rows in readers.EDGES.items() for r in rows])}) v(k, value, category) ON k = ['numeric', 'string', 'list', 'dict', 'numeric'][p_partkey % 5 + 1]")
def edge_cases(t: Tables) -> DataFrame:
    """A call with every odd value for a function of each part, by the kind of its parameter."""
    kind = F.element_at(x.literal(["numeric", "string", "list", "dict", "other"]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return readers.edge_calls(t.part.select(F.concat(F.lit("f"), "p_partkey").alias("name"), kind.alias("kind")), "name", "kind")


@query("f12_describe_file", "SELECT p_brand AS file, p_brand || ': ' || count(*) || ' functions, ' || sum(p_size) || ' lines' AS about FROM part GROUP BY p_brand")
def describe_file(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("file")).agg(F.count("*").alias("n"), F.sum("p_size").alias("s")).select("file", F.concat("file", F.lit(": "), "n", F.lit(" functions, "), "s", F.lit(" lines")).alias("about"))


@query("a23_brain_summary", "SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY lang")
def brain_summary(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("a25_index_stats", "SELECT lang, count(*) AS total, count(*) FILTER (n_chars >= 500) AS indexed, count(*) FILTER (n_chars < 500) AS skipped FROM documents GROUP BY lang")
def index_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") >= 500).alias("indexed"), F.count_if(F.col("n_chars") < 500).alias("skipped"))


@query("a27_entity_type_counts", "SELECT kind, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('never')) k(kind) LEFT JOIN events ON event_type = kind GROUP BY kind")
def entity_type_counts(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([(k,) for k in ("click", "error", "purchase", "signup", "view", "never")], "kind string")
    n = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("a29_adapter_stats", "SELECT s_nationkey, count(*) FILTER (s_acctbal >= 0) AS active, count(*) FILTER (s_acctbal < 0) AS failed FROM supplier GROUP BY 1")
def adapter_stats(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") >= 0).alias("active"), F.count_if(F.col("s_acctbal") < 0).alias("failed"))


@query("a31_plan_progress", "SELECT l_orderkey AS plan, round(avg((l_returnflag <> 'N')::INT), 6) AS done, min(l_linenumber) FILTER (l_returnflag = 'N') AS next_step FROM lineitem GROUP BY 1")
def plan_progress(t: Tables) -> DataFrame:
    """Finished share of a plan's steps and its first unfinished one."""
    done = F.col("l_returnflag") != "N"
    return t.lineitem.groupBy(F.col("l_orderkey").alias("plan")).agg(F.round(F.avg(done.cast("int")), 6).alias("done"), F.min(F.when(~done, F.col("l_linenumber"))).alias("next_step"))


@query("k13_vector_upsert", "WITH o AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0), n AS (SELECT vec_id, 1::INT AS label FROM embeddings WHERE vec_id % 2 = 0) SELECT coalesce(o.vec_id, n.vec_id) AS vec_id, coalesce(n.label, o.label) AS label, CASE WHEN n.vec_id IS NULL THEN 'kept' WHEN o.vec_id IS NULL THEN 'added' WHEN o.label IS NOT DISTINCT FROM n.label THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.vec_id = n.vec_id")
def vector_upsert(t: Tables) -> DataFrame:
    old, new = t.embeddings.where("vec_id % 3 <> 0").select("vec_id", "label"), t.embeddings.where("vec_id % 2 = 0").select("vec_id", F.lit(1).alias("label"))
    return upsert(old, new, ["vec_id"])


@query("m14_complete_keywords", f"WITH k AS (SELECT * FROM (VALUES {_rows_sql(assist.completion_rows())}) v(language, text, kind, label, inserted)), p AS (SELECT p_partkey, substring(p_name, 1, 1 + p_size % 2) AS prefix, ['python', 'js', 'go', 'other'][p_partkey % 4 + 1] AS language FROM part) SELECT p_partkey, text, k.kind, label, inserted FROM p JOIN k ON (k.language = p.language OR k.language = '*') AND starts_with(lower(text), prefix) AND lower(text) <> prefix")
def complete_keywords(t: Tables) -> DataFrame:
    """Key words of a language, and snippets, for what is typed: the first one or two letters of each part's name."""
    language = F.element_at(x.literal(["python", "js", "go", "other"]), (F.col("p_partkey") % 4 + 1).cast("int"))
    typed = t.part.select("p_partkey", F.expr("substring(p_name, 1, 1 + p_size % 2)").alias("prefix"), language.alias("language"))
    return assist.complete(typed, "p_partkey", "prefix", "language")


@query("m9_update_signature", "SELECT p_partkey, regexp_replace(p_name, '\\bring\\b', 'ring(x)') AS name FROM part")
def update_signature(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.regexp_replace("p_name", r"\bring\b", "ring(x)").alias("name"))


@query("m20_store_solution", "SELECT substring(md5(lower(p_name)), 1, 12) AS key, count(*) AS tries, max(p_size) AS best FROM part GROUP BY 1")
def store_solution(t: Tables) -> DataFrame:
    return report.solutions(t.part, "p_name", "p_size")


@query("m33_evolution_narrative", "SELECT p_type, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'SMALL' THEN 'little' ELSE 'other' END || ' parts: ' || count(*) AS narrative FROM part GROUP BY p_type")
def evolution_narrative(t: Tables) -> DataFrame:
    return report.narrative(t.part, "p_type", {"ECONOMY": "cheap", "SMALL": "little"}, "other", "parts")


@query("m34_plan_parse", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def plan_parse(t: Tables) -> DataFrame:
    """JSON inside free text."""
    said = F.concat(F.lit("the plan is "), "props", F.lit(" so far"))
    return t.events.select("event_id", F.from_json(F.regexp_extract(said, r"(\{.*\})", 1), "k int")["k"].alias("k"))


@query("m37_echo_stats", "SELECT l_orderkey, round(sum(l_linenumber) / sum(l_quantity), 6) AS echoed, round(1 / (1 - least(0.99, sum(l_linenumber) / sum(l_quantity))), 6) AS speedup FROM lineitem GROUP BY 1")
def echo_stats(t: Tables) -> DataFrame:
    return report.echo(t.lineitem, "l_orderkey", "l_linenumber", "l_quantity")


@query("m38_adapter_registry", "SELECT s_nationkey, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS active FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def adapter_registry(t: Tables) -> DataFrame:
    return report.active(t.supplier, "s_nationkey", "s_suppkey", "s_acctbal", F.col("s_acctbal") > 0)


@query("m38_registry_state", "WITH e AS (SELECT user_id % 40 AS registry, 'a' || (event_id % 4) AS name, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'register' WHEN 'click' THEN 'activate' WHEN 'error' THEN 'delete' ELSE 'deactivate' END AS op, value AS score FROM events), w AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('create', 'register', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY registry, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'delete') <> 'delete' AS there FROM e), l AS (SELECT registry, name, max(seq) FILTER (op = 'delete') AS gone, max(seq) FILTER (op = 'create' OR op = 'register' AND NOT there) AS begun FROM w GROUP BY ALL), k AS (SELECT * FROM l WHERE begun IS NOT NULL AND (gone IS NULL OR gone < begun)), s AS (SELECT k.registry, k.name, count(*) AS n, arg_max(score, seq) AS score FROM w JOIN k ON k.registry = w.registry AND k.name = w.name AND seq >= begun WHERE op = 'register' GROUP BY ALL), a AS (SELECT registry, max(seq) AS at_, arg_max(CASE WHEN op = 'activate' THEN name ELSE '' END, seq) AS active FROM w WHERE op = 'activate' AND there OR op = 'deactivate' GROUP BY ALL) SELECT k.registry, k.name, 1 + coalesce(n, 0) AS version, coalesce(score, 0.0) AS score, coalesce(active = k.name AND (gone IS NULL OR gone < at_), FALSE) AS active FROM k LEFT JOIN s ON s.registry = k.registry AND s.name = k.name LEFT JOIN a ON a.registry = k.registry")
def registry_state(t: Tables) -> DataFrame:
    """What forty registries hold and have active after all that was done to them."""
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "register").when(F.col("event_type") == "click", "activate").when(F.col("event_type") == "error", "delete").otherwise("deactivate")
    e = t.events.select((F.col("user_id") % 40).alias("registry"), F.concat(F.lit("a"), F.col("event_id") % 4).alias("name"), F.col("event_id").alias("seq"), op.alias("op"), F.col("value").alias("score"))
    return versions.state(e, "registry", "name", "seq", "op", "score")


@query("m43_few_shot_pick", "SELECT p_partkey, contains(p_name, 'red')::INT + contains(p_name, 'ring')::INT AS hits FROM part WHERE contains(p_name, 'red')::INT + contains(p_name, 'ring')::INT >= 2 ORDER BY 2 DESC, 1 LIMIT 1")
def few_shot_pick(t: Tables) -> DataFrame:
    return report.best_named(t.part, "p_partkey", "p_name", ["red", "ring"], 2)


@query("m44_code_fixups", "SELECT doc_id, length(regexp_replace(replace(text, chr(9), '    '), '[ ]+' || chr(10), chr(10), 'g')) AS n FROM documents")
def code_fixups(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(F.regexp_replace(F.replace("text", F.lit("\t"), F.lit("    ")), " +\n", "\n")).cast("long").alias("n"))


@query("t53_context_assemble", "WITH p AS (SELECT source, doc_id, sum(n_chars // 4) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) SELECT source, count(*) AS parts, max(used)::BIGINT AS used FROM p WHERE used <= 4000 GROUP BY source")
def context_assemble(t: Tables) -> DataFrame:
    """Parts of a source that fit a budget of tokens, in order."""
    fitting = series.budgeted(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], F.floor(F.col("n_chars") / 4), 4000)
    return fitting.groupBy("source").agg(F.count("*").alias("parts"), F.max("used").alias("used"))


@query("m21_memory_context", "SELECT conv_id, list(turn ORDER BY n DESC, turn)[1:3] AS turns FROM (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length(text) > 20) GROUP BY conv_id")
def memory_context(t: Tables) -> DataFrame:
    rows = t.conversations.where("length(text) > 20").select("conv_id", F.struct((-F.length("text")).alias("n"), "turn").alias("r"))
    return rows.groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list("r")), 1, 3).alias("r")).select("conv_id", F.col("r.turn").alias("turns"))


@query("m30_verify_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'refuted' ELSE 'verified' END AS verdict FROM orders")
def verify_text(t: Tables) -> DataFrame:
    s = t.orders.select("o_orderkey", F.concat("o_orderkey", F.lit(" + 2 = "), F.col("o_orderkey") + F.when(F.col("o_orderkey") % 7 == 0, 3).otherwise(2)).alias("text"))
    return s.select("o_orderkey", F.when(F.exists(x.arithmetic_claims(F.col("text")), lambda c: ~c["holds"]), "refuted").otherwise("verified").alias("verdict"))


@query("m41_mixed_context", "SELECT conv_id, count(*) AS parts FROM (SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') UNION ALL SELECT conv_id, turn FROM conversations WHERE length(text) > 200) GROUP BY conv_id")
def mixed_context(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "text")
    return c.where(F.contains(F.lower("text"), F.lit("the"))).unionByName(c.where("length(text) > 200")).groupBy("conv_id").agg(F.count("*").alias("parts"))
