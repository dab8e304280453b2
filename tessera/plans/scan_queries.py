"""Scan queries over documents and over a small code corpus that is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fuzzy, report, scan
from .registry import Tables, query

#: Source lines that stand for files, one a row of part.
_CODE = ("import os\nos.system(cmd)\n", "password = 'abcdefghijkl1234'\n", "# eval(x)\nprint('eval(x)')\n", "def f(q):\n    db.execute(f'select {q}')\n", "h = hashlib.md5(data)\n", "x = 1\n")


def code(t: Tables) -> DataFrame:
    """(path, text): a file of one of the snippets for every part."""
    text = F.element_at(F.array(*[F.lit(c) for c in _CODE]), (F.col("p_partkey") % len(_CODE) + 1).cast("int"))
    return t.part.select(F.concat("p_brand", F.lit("/f"), "p_partkey", F.lit(".py")).alias("path"), text.alias("text"), "p_partkey")


_SQL_CODE = "c AS (SELECT p_partkey, [" + ", ".join("'" + c.replace("'", "''") + "'" for c in _CODE) + f"][p_partkey % {len(_CODE)} + 1] AS text FROM part)"


@query("t38_sink_match", f"WITH {_SQL_CODE} SELECT p_partkey, list_filter([CASE WHEN regexp_matches(text, '\\.execute\\s*\\(\\s*[fF][\"'']') THEN 'sql_injection' END, CASE WHEN regexp_matches(text, '\\bos\\.system\\s*\\(|(^|[^\\w.])eval\\s*\\(') THEN 'command_injection' END, CASE WHEN regexp_matches(text, 'hashlib\\.md5\\b') THEN 'weak_crypto' END, CASE WHEN regexp_matches(text, '(?i)password\\s*=\\s*[\"''][a-zA-Z0-9_\\-+/=]{{12,}}[\"'']') THEN 'hardcoded_secret' END], lambda x: x IS NOT NULL) AS classes FROM c")
def sink_match(t: Tables) -> DataFrame:
    return code(t).select("p_partkey", scan.classes(F.col("text"), scan.SINKS).alias("classes"))


@query("t38_source_match", "SELECT doc_id, regexp_matches(text, '\\bsys\\.argv\\b|\\bargparse\\b') AS cli FROM documents")
def source_match(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_contains(scan.classes(F.col("text"), {"cli_arg": scan.SOURCES["cli_arg"][:2]}), "cli_arg").alias("cli"))


@query("t39_finding_rows", "SELECT p_brand || '/f' || p_partkey || '.py' AS path, CASE p_partkey % 6 WHEN 0 THEN 'command_injection' WHEN 1 THEN 'hardcoded_secret' WHEN 3 THEN 'sql_injection' ELSE 'weak_crypto' END AS class, CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 1 END AS line FROM part WHERE p_partkey % 6 IN (0, 1, 3, 4)")
def finding_rows(t: Tables) -> DataFrame:
    """Matches with their lines; what stands in comments and strings does not count."""
    return scan.findings(code(t), "path", "text").select("path", "class", "line")


@query("t37_strip_strings_comments", r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'import os' || chr(10) || 'os.system(cmd)' WHEN 1 THEN 'password = ' || chr(39) || repeat(' ', 16) || chr(39) WHEN 2 THEN repeat(' ', 9) || chr(10) || 'print(' || chr(39) || repeat(' ', 7) || chr(39) || ')' WHEN 3 THEN 'def f(q):' || chr(10) || '    db.execute(f' || chr(39) || repeat(' ', 10) || chr(39) || ')' WHEN 4 THEN 'h = hashlib.md5(data)' ELSE 'x = 1' END || chr(10) AS clean FROM part""")
def strip_strings(t: Tables) -> DataFrame:
    return scan.blanked(code(t), "p_partkey", "text", "clean")


@query("t40_secret_scan", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) SELECT doc_id, n AS line FROM l WHERE regexp_matches(line, '(?i)(password|token|secret)\\s*=\\s*[\"''][a-zA-Z0-9_\\-+/=]{12,}[\"'']') AND NOT starts_with(ltrim(line), '#')")
def secret_scan(t: Tables) -> DataFrame:
    """Lines with a credential; whole texts are tested before they are cut into lines."""
    rule = r"(?i)(password|token|secret)\s*=\s*[\"'][a-zA-Z0-9_\-+/=]{12,}[\"']"
    lines = t.documents.where(F.col("text").rlike(rule)).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s"))
    return lines.where(F.col("s").rlike(rule) & ~F.ltrim("s").startswith("#")).select("doc_id", (F.col("i") + 1).cast("long").alias("line"))


@query("t41_taint_finding", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' ELSE 'CWE-918' END AS cwe, CASE p_partkey % 3 WHEN 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 0.85 AS confidence FROM part")
def taint_finding(t: Tables) -> DataFrame:
    c = F.element_at(F.array(*[F.lit(x) for x in ("sql_injection", "xss", "ssrf")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", scan.lookup(scan.CWE, c).alias("cwe"), scan.lookup(scan.SEVERITY, c).alias("severity"), F.lit(0.85).alias("confidence"))


@query("t42_stage_classify", "SELECT user_id, arg_max(event_type, (CASE event_type WHEN 'error' THEN 10 WHEN 'purchase' THEN 9 WHEN 'signup' THEN 5 ELSE 0 END, event_type)) AS stage FROM events GROUP BY user_id")
def stage_classify(t: Tables) -> DataFrame:
    return report.strongest(t.events, "user_id", "event_type", {"error": scan.STAGE_WEIGHT["rce"], "purchase": scan.STAGE_WEIGHT["destroy"], "signup": scan.STAGE_WEIGHT["exfil"]})


@query("t43_chain_confidence", "SELECT event_id, round(greatest(0.2, least(0.98, greatest(0.25, 0.75 - 0.15 * (event_id % 5)) * (0.7 + 0.3 * least(value / 50, 1)) + 0.05)), 6)::DOUBLE AS confidence FROM events")
def chain_confidence(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(scan.chain_confidence(F.col("event_id") % 5, F.least(F.col("value") / 50, F.lit(1.0)), F.lit(0.05)), 6).alias("confidence"))


@query("f18_stale_filter", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents), f AS (SELECT doc_id, 1 + doc_id % 12 AS line FROM documents) SELECT f.doc_id, f.line, coalesce(bool_or(regexp_matches(l.line, 'token|secret|license|Licen')), FALSE) AS fresh FROM f LEFT JOIN l ON l.doc_id = f.doc_id AND l.n BETWEEN f.line - 4 AND f.line + 4 GROUP BY ALL")
def stale_filter(t: Tables) -> DataFrame:
    """A finding is fresh while its pattern still stands within four lines of its place."""
    at = (F.col("doc_id") % 12 + 1).cast("int")
    near = F.slice(F.split("text", "\n", -1), F.greatest(F.lit(1), at - 4), F.least(F.lit(9), at + 4))
    return t.documents.select("doc_id", at.alias("line"), F.exists(near, lambda s: s.rlike("token|secret|license|Licen")).alias("fresh"))


@query("k11_export_sarif")
def export_sarif(t: Tables) -> DataFrame:
    return scan.sarif(scan.findings(code(t), "path", "text"), "path")


@query("k12_export_markdown", "SELECT '| ' || o_orderpriority || ' | ' || count(*) || ' |' AS line FROM orders GROUP BY o_orderpriority")
def export_markdown(t: Tables) -> DataFrame:
    return report.markdown_counts(t.orders, "o_orderpriority")


@query("m11_reasoning_gate", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderpriority, o_orderkey LIMIT 30")
def reasoning_gate(t: Tables) -> DataFrame:
    return report.worst_first(t.orders, F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int"), 3, "o_orderkey", 30).select("o_orderkey")


@query("m11_reasoned_findings", "WITH p AS (SELECT p_partkey, p_name, p_size, p_partkey % 7 AS v, 0.3 + (p_size % 5) / 10 AS c FROM part) SELECT p_partkey, CASE WHEN v IN (0, 4, 6) THEN 'exploitable' WHEN v = 3 THEN 'uncertain' ELSE '' END AS verdict, round(CASE v WHEN 0 THEN 0.9 WHEN 4 THEN greatest(c, 0.75) WHEN 6 THEN 0.9 ELSE c END, 6)::DOUBLE AS confidence, CASE v WHEN 0 THEN 'from ' || p_name || chr(10) || 'and more' ELSE '' END AS reasoning, CASE v WHEN 0 THEN 'use ' || p_size WHEN 3 THEN 'none' ELSE '' END AS fix, v = 6 AS escalated FROM p WHERE v NOT IN (1, 2)")
def reasoned_findings(t: Tables) -> DataFrame:
    """What a model says of findings, read from its replies: certain ones rise, cleared ones go, a deeper model decides the uncertain."""
    replies = F.array(
        F.concat(F.lit("VERDICT: exploitable\nCONFIDENCE: 90\nREASONING: from "), "p_name", F.lit("\nand more\n FIX: use "), "p_size"),
        F.lit("Verdict - NOT_exploitable at all\nConfidence: 0.1\nreasoning: constant"),
        F.lit("no this is safe"),
        F.lit("verdict: maybe so\nfix: none"),
        F.lit("yes it is, confidence: .75"),
        F.lit(None).cast("string"),
        F.lit("verdict: unclear"),
    )
    v = F.col("p_partkey") % 7
    rows = t.part.select("p_partkey", (F.lit(0.3) + F.col("p_size") % 5 / 10).alias("confidence"), F.element_at(replies, (v + 1).cast("int")).alias("reply"), F.when(v == 6, "VERDICT: real, from the network").alias("deep"))
    out = report.reasoned(rows, "reply", "confidence", "deep")
    return out.select("p_partkey", "verdict", F.round("confidence", 6).alias("confidence"), "reasoning", "fix", "escalated")


@query("m12_chain_narrative", "SELECT o_orderkey, array_to_string(list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey), ' -> ') AS narrative FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def chain_narrative(t: Tables) -> DataFrame:
    steps = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return t.orders.select("o_orderkey").join(steps, "o_orderkey").select("o_orderkey", F.array_join(F.transform("s.l_partkey", lambda p: p.cast("string")), " -> ").alias("narrative"))


@query("m13_load_entry_findings", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW' ORDER BY o_orderpriority, o_orderkey LIMIT 100")
def load_entry_findings(t: Tables) -> DataFrame:
    return report.worst_first(t.orders, F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int"), 1, "o_orderkey", 100).select("o_orderkey", "o_orderpriority")


@query("u10_claims_dedup", "SELECT DISTINCT conv_id, claim FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '(?:^| )([a-z]{6,})', 1)) AS claim FROM conversations) QUALIFY dense_rank() OVER (PARTITION BY conv_id ORDER BY claim) <= 10")
def claims_dedup(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?:^| )([a-z]{6,})"), F.lit(1))).alias("claim")).distinct()
    return c.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("claim"))).where("n <= 10").drop("n")


@query("m36_syntax_check", "SELECT p_partkey, p_partkey % 4 = 0 AS sound, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'SyntaxError: invalid syntax (line ' || (p_size % 3 + 2) || ')' WHEN 2 THEN 'empty code' ELSE 'SyntaxError: expected '':'' (line 1)' END AS error FROM part")
def syntax_check(t: Tables) -> DataFrame:
    """Code that can be compiled, that breaks off on some line, and none at all."""
    codes = F.array(F.concat(F.lit("f = lambda x: x\nprint(f("), "p_size", F.lit("))\n")), F.concat(F.repeat(F.lit("x = 1\n"), (F.col("p_size") % 3 + 1).cast("int")), F.lit("y = = 2\n")), F.lit(" \n"), F.lit("def f()\n    pass\n"))
    return scan.checked(t.part.select("p_partkey", F.element_at(codes, (F.col("p_partkey") % 4 + 1).cast("int")).alias("code")), "p_partkey", "code")


@query("m36_lint", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) SELECT doc_id, n AS line FROM l WHERE length(line) > 1500 OR regexp_matches(line, '[ ]+$')")
def lint(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s"))
    return lines.where((F.length("s") > 1500) | F.col("s").rlike(" +$")).select("doc_id", (F.col("i") + 1).cast("long").alias("line"))


@query("m16_claim_verifiers", "WITH c AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1) SELECT l_partkey, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_size > 25 THEN 'wrong size' ELSE 'verified' END AS verdict FROM c LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 2 = 0")
def claim_verifiers(t: Tables) -> DataFrame:
    return report.verdicts(t.lineitem.where("l_linenumber = 1"), "l_partkey", t.part.where("p_partkey % 2 = 0"), "p_partkey", F.col("p_size") > 25)


@query("m15_identifier_correction", "WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part), p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS name, p_partkey % 4 AS v FROM part), t AS (SELECT *, CASE v WHEN 0 THEN substring(name, 2) WHEN 1 THEN 'q' || name WHEN 2 THEN name || right(name, 1) ELSE name END AS typed FROM p) SELECT p_partkey, '# ' || typed || '(1)' || chr(10) || 'print(' || CASE WHEN typed IN (SELECT name FROM n) OR starts_with(typed, 'new_') THEN typed ELSE name END || '(x), new_' || typed || '(x))' || chr(10) || 'w = Widget' || CASE v WHEN 1 THEN 's.' ELSE 'Box.' END || typed || '(y)' AS code FROM t")
def identifier_correction(t: Tables) -> DataFrame:
    """Code of every part, with a misspelt function called and a misspelt class named: the first place of each is set right."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    p = t.part.select("p_partkey", name.alias("name"), (F.col("p_partkey") % 4).alias("v"))
    typed = F.when(F.col("v") == 0, F.expr("substring(name, 2)")).when(F.col("v") == 1, F.concat(F.lit("q"), "name")).when(F.col("v") == 2, F.concat("name", F.expr("right(name, 1)"))).otherwise(F.col("name"))
    of_class = F.when(F.col("v") == 0, "WidgetBx.").when(F.col("v") == 1, "Widgets.").when(F.col("v") == 2, "WidgetBOX.").otherwise("WidgetBox.")
    p = p.withColumn("typed", typed)
    code = F.concat(F.lit("# "), "typed", F.lit("(1)\nprint("), "typed", F.lit("(x), new_"), "typed", F.lit("(x))\nw = "), of_class, "typed", F.lit("(y)"))
    classes = t.spark.createDataFrame([("WidgetBox",), ("Widgets",)], "name string")
    return fuzzy.corrected(p.select("p_partkey", code.alias("code")), "p_partkey", "code", p.select("name").distinct(), classes).select("p_partkey", "code")
