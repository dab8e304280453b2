"""Symbols and the graph of code: every part is a file, in one of many languages or in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import claims, code_graph, graph, scan
from ..operators.store import settled
from ..sources import symbols
from .registry import Tables, query

#: A file of each language (@@ is the part's key), and what it defines: kind, name, line, lines on, owner, arguments, returns, bases.
FILES = (
    ("ts", "export class C@@ extends Base {\n  async go(a: int, b) {\n  }\n}\nexport async function f@@(x: string, y) { return 1 }\nconst g@@ = async (p) => p\nvar h@@ = function(q) { return q }\nimport { z } from './lib/z'\nconst r = require(\"fs\")\nif (x) { }\n",
     (("function", "f@@", 5, 5, None, "x,y", None, ""), ("function", "g@@", 6, 5, None, "p", None, ""), ("function", "h@@", 7, 5, None, "q", None, ""), ("function", "go", 2, 5, None, "a,b", None, ""), ("class", "C@@", 1, 10, None, "", None, "Base"), ("import", "./lib/z", 8, 0, None, "", None, ""), ("import", "fs", 9, 0, None, "", None, ""))),
    ("go", "package main\nimport \"fmt\"\ntype T@@ struct {\n}\ntype I@@ interface {\n}\nfunc F@@(a int, b string) (int, error) {\nfunc (t *T@@) M(c int) {\n",
     (("function", "F@@", 7, 10, None, "a,b", "int, error", ""), ("function", "M", 8, 10, "T@@", "c", None, ""), ("class", "T@@", 3, 10, None, "", None, ""), ("class", "I@@", 5, 10, None, "", None, ""), ("import", "fmt", 2, 0, None, "", None, ""))),
    ("rs", "use std::fs\npub struct S@@ {\nenum E@@ {\npub trait Q@@ {\npub async fn f@@<T>(a: T, b: u8) -> u8 {\n",
     (("function", "f@@", 5, 10, None, "a,b", "u8", ""), ("class", "S@@", 2, 10, None, "", None, ""), ("class", "E@@", 3, 10, None, "", None, ""), ("class", "Q@@", 4, 10, None, "", None, ""), ("import", "std::fs", 1, 0, None, "", None, ""))),
    ("kt", "import java.util.List;\npublic abstract class C@@ extends B implements X, Y {\n  public static int m@@(int a, String b) throws E {\n  if (a) {\n",
     (("class", "C@@", 2, 20, None, "", None, "B,X,Y"), ("function", "m@@", 3, 10, None, "a,b", "int", ""), ("import", "java.util.List", 1, 0, None, "", None, ""))),
    ("cpp", "#include <stdio.h>\nstruct P@@ : public Q {\nstatic inline int f@@(char *a, int b) {\nwhile (x) {\n",
     (("function", "f@@", 3, 10, None, "a,b", "int", ""), ("class", "P@@", 2, 10, None, "", None, "Q"), ("import", "stdio.h", 1, 0, None, "", None, ""))),
    ("sql", "create or replace function f@@(a int, b text) returns int;\nCREATE TABLE IF NOT EXISTS t@@ (x int);\n",
     (("function", "f@@", 1, 10, None, "a,b", None, ""), ("class", "t@@", 2, 10, None, "", None, ""))),
    ("rb", "class A@@ < B\n  def self.go(x, y = 1)\nmodule M@@\n  def plain\n",
     (("function", "go", 2, 5, None, "x,y = 1", None, ""), ("function", "plain", 4, 5, None, "", None, ""), ("class", "A@@", 1, 10, None, "", None, "B"), ("class", "M@@", 3, 10, None, "", None, ""))),
    ("php", "class A@@ extends B {\n  public static function f@@(int $a = 3, $b) {\n",
     (("function", "f@@", 2, 10, None, "a,b", None, ""), ("class", "A@@", 1, 10, None, "", None, "B"))),
    ("swift", "public protocol P@@: Q {\n  public static func f@@(a: Int, b: String) -> Bool {\n",
     (("function", "f@@", 2, 10, None, "a,b", "Bool", ""), ("class", "P@@", 1, 10, None, "", None, "Q"))),
    ("dart", "abstract class A@@ extends B {\n  void f@@(int a, String b) async {\n",
     (("function", "f@@", 2, 10, None, "a,b", None, ""), ("class", "A@@", 1, 10, None, "", None, "B"))),
    ("exs", "defmodule App.M@@ do\n  def f@@(a, b) do\n  defp g@@(c) do\n",
     (("function", "f@@", 2, 5, None, "a,b", None, ""), ("function", "g@@", 3, 5, None, "c", None, ""), ("class", "App.M@@", 1, 10, None, "", None, ""))),
    ("bash", "function f@@() {\ng@@ () {\n", (("function", "f@@", 1, 5, None, "", None, ""), ("function", "g@@", 2, 5, None, "", None, ""))),
    ("lua", "local function M.f@@(a, b)\n", (("function", "M.f@@", 1, 5, None, "a,b", None, ""),)),
    ("R", "f@@ <- function(a = 1, b)\n", (("function", "f@@", 1, 5, None, "a,b", None, ""),)),
    ("jl", "mutable struct S@@\nfunction f@@(a::Int, b)\n", (("function", "f@@", 2, 5, None, "a,b", None, ""), ("class", "S@@", 1, 10, None, "", None, ""))),
    ("zig", "const S@@ = packed struct {\npub fn f@@(a: u8) u8 {\n", (("function", "f@@", 2, 5, None, "a", None, ""), ("class", "S@@", 1, 10, None, "", None, ""))),
    ("nim", "type T@@ = ref object\nproc f@@(a: int, b: int)\n", (("function", "f@@", 2, 5, None, "a,b", None, ""), ("class", "T@@", 1, 10, None, "", None, ""))),
    ("ml", "class Widget@@ {\npublic int area@@(int w, h: int) {\ndef go@@(x)\nnamespace Deep@@\ntype lower@@\nif (x) {\n",
     (("function", "area@@", 2, 5, None, "w,int", None, ""), ("function", "go@@", 3, 5, None, "x", None, ""), ("class", "Widget@@", 1, 10, None, "", None, ""), ("class", "Deep@@", 4, 10, None, "", None, ""))),
)


def _filled(text: str) -> Column:
    return F.replace(F.lit(text), F.lit("@@"), F.col("p_partkey").cast("string"))


def _picked(values: list[Column]) -> Column:
    return F.element_at(F.array(*values), (F.col("p_partkey") % len(values) + 1).cast("int"))


def _s9_sql() -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {text(ext)}, {text(kind)}, {text(name)}, {line}, {on}, {text(owner)}, {text(args)}, {text(returns)}, {text(bases)})" for i, (ext, _, found) in enumerate(FILES) for kind, name, line, on, owner, args, returns, bases in found)
    fill = lambda c: f"replace({c}, '@@', p_partkey::VARCHAR)"
    cut = lambda c: f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split({c}, ',') END"
    return f"SELECT 'src/f' || p_partkey || '.' || ext AS path, kind, {fill('name')} AS name, {fill('owner')} AS owner, (p_size % 4 + 1 + line)::INT AS line, (p_size % 4 + 1 + line + lines)::INT AS last, {cut('args')} AS args, returns, {cut('bases')} AS bases FROM part JOIN (VALUES {rows}) v(i, ext, kind, name, line, lines, owner, args, returns, bases) ON p_partkey % {len(FILES)} = i"


@query("s9_scan_source_regex", _s9_sql())
def scan_source_regex(t: Tables) -> DataFrame:
    """The names of a file also stand in the comments above, of as many lines as the part's size says, with a form feed in each."""
    head = F.repeat(F.concat(F.lit("// C"), "p_partkey", F.lit(" f"), "p_partkey", F.lit("\f"), "p_name", F.lit("\n")), (F.col("p_size") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/f"), "p_partkey", F.lit("."), _picked([F.lit(ext) for ext, _, _ in FILES]))
    files = t.part.select(path.alias("path"), F.concat(head, _picked([_filled(body) for _, body, _ in FILES])).alias("text"))
    return symbols.source_symbols(files, "path", "text").select("path", "kind", "name", "owner", "line", "last", "args", "returns", "bases")


#: Files that a task parses: rows of parts are short, so few of the tasks that read them would have all the files.
TASK = 4096


def _dealt(parts: DataFrame) -> DataFrame:
    """The columns that files are made of, dealt to tasks of about `TASK` files."""
    return parts.select("p_partkey", "p_name", "p_size").repartition(max(1, -(-parts.count() // TASK)), "p_partkey")


_PYTHON = """import json
from util import helper as h, other
LIMIT = 3
class K@@(Base, pkg.Other):
    @cached(3)
    def run(self, x: int, y: 'T' = 1) -> str:
        return self.step(x) or h(x)
    def step(self, y):
        for z in [json.dumps(z) for z in y if z and LIMIT]:
            self.tool.use(z)
def f@@(a, b):
    helper(a)
    f##(b), load(a), run(b)
    rare%%(a)
    obj().close(open(a))
"""
_LOAD, _RARE = "def load(a) -> dict[str, int]:\n    pass\n", "def rare%%():\n    load(1)\n"


def project(t: Tables) -> DataFrame:
    """(path, text): a Python file of every part, in folders of five packages; every third defines `load`, some a rare name."""
    key = F.col("p_partkey")
    fill = lambda text: F.replace(F.replace(F.replace(F.lit(text), F.lit("@@"), key.cast("string")), F.lit("##"), F.floor(key / 2).cast("string")), F.lit("%%"), (key % 50).cast("string"))
    head = F.repeat(F.concat(F.lit("# "), "p_name", F.lit("\f def f():\n")), (F.col("p_size") % 4).cast("int"))
    path = F.concat(F.lit("pkg"), F.col("p_size") % 5, F.lit("/d"), key % 40, F.lit("/m"), key, F.lit(".py"))
    text = F.concat(head, fill(_PYTHON), F.when(key % 3 == 0, _LOAD).otherwise(""), F.when(key < 200, fill(_RARE)).otherwise(""))
    return _dealt(t.part).select(path.alias("path"), text.alias("text"))


def _found(t: Tables) -> DataFrame:
    """The symbols of the project, written once: they are read several times, and a file is parsed by Python."""
    return settled(symbols.source_symbols(project(t), "path", "text"))


_PROJECT = "p AS (SELECT p_partkey AS k, p_size % 4 AS n, 'pkg' || (p_size % 5) AS top, 'pkg' || (p_size % 5) || '/d' || (p_partkey % 40) AS dir, 'pkg' || (p_size % 5) || '/d' || (p_partkey % 40) || '/m' || p_partkey || '.py' AS path FROM part)"
_FUNCTIONS = "f AS (SELECT path || ':f' || k AS id, 'f' || k AS name, path, dir, top, k, NULL AS owner FROM p UNION ALL SELECT path || ':K' || k || '.' || m, m, path, dir, top, k, 'K' || k FROM p, (VALUES ('run'), ('step')) v(m) UNION ALL SELECT path || ':load', 'load', path, dir, top, k, NULL FROM p WHERE k % 3 = 0 UNION ALL SELECT path || ':rare' || (k % 50), 'rare' || (k % 50), path, dir, top, k, NULL FROM p WHERE k < 200)"
_CALLS = "c AS (SELECT path || ':K' || k || '.run' AS source, receiver, name, path, dir, top FROM p, (VALUES ('self', 'step'), ('', 'h'), ('', 'cached')) v(receiver, name) UNION ALL SELECT path || ':K' || k || '.step', receiver, name, path, dir, top FROM p, (VALUES ('json', 'dumps'), ('self.tool', 'use')) v(receiver, name) UNION ALL SELECT path || ':f' || k, receiver, replace(replace(name, '##', (k // 2)::VARCHAR), '%%', (k % 50)::VARCHAR), path, dir, top FROM p, (VALUES ('', 'helper'), ('', 'f##'), ('', 'load'), ('', 'run'), ('', 'rare%%'), ('_expr_', 'close'), ('', 'obj'), ('', 'open')) v(receiver, name) UNION ALL SELECT path || ':rare' || (k % 50), '', 'load', path, dir, top FROM p WHERE k < 200)"
_MEANT = f"WITH {_PROJECT}, {_FUNCTIONS}, {_CALLS}, m AS (SELECT c.source, c.receiver, c.name, c.top, any_value(c.path) AS path, count(f.id) AS n, min(f.id) FILTER (f.path = c.path) AS here, arg_min(f.id, f.path) FILTER (f.dir = c.dir) AS near, count(*) FILTER (f.top = c.top) AS own, arg_min(f.id, f.path) FILTER (f.top = c.top) AS first_own, count(DISTINCT f.top) FILTER (f.top <> c.top) AS others, arg_min(f.id, f.path) AS first FROM c LEFT JOIN f ON f.name = c.name GROUP BY 1, 2, 3, 4), r AS (SELECT source, receiver, name, CASE WHEN receiver = 'json' THEN '__external__:json.dumps' WHEN receiver = '' AND name = 'helper' THEN '__external__:helper' ELSE coalesce(CASE WHEN receiver = 'self' THEN here WHEN n = 1 THEN first WHEN here IS NOT NULL THEN here WHEN near IS NOT NULL THEN near WHEN n > 5 THEN NULL WHEN others > 0 THEN CASE WHEN own = 1 THEN first_own END ELSE first END, '__unresolved__:' || name) END AS target FROM m)"


@query("s8_scan_source_ast", f"WITH {_PROJECT} SELECT path, kind, replace(replace(name, '@@', k::VARCHAR), '%%', (k % 50)::VARCHAR) AS name, replace(owner, '@@', k::VARCHAR) AS owner, (n + line + shift)::INT AS line, (n + last + shift)::INT AS last, complexity::INT AS complexity, CASE WHEN args = '' THEN []::VARCHAR[] ELSE string_split(args, ', ') END AS args, returns, CASE WHEN bases = '' THEN []::VARCHAR[] ELSE string_split(bases, ', ') END AS bases, replace(replace(calls, '##', (k // 2)::VARCHAR), '%%', (k % 50)::VARCHAR) AS calls FROM (SELECT *, CASE WHEN name = 'rare%%' AND k % 3 <> 0 THEN -2 ELSE 0 END AS shift FROM p, (VALUES ('import', 'json', NULL, 1, 1, 1, '', NULL, '', ''), ('import', 'util', NULL, 2, 2, 1, '', NULL, '', ''), ('global', 'LIMIT', NULL, 3, 3, 1, '', NULL, '', ''), ('class', 'K@@', NULL, 4, 10, 1, '', NULL, 'Base, pkg.Other', ''), ('function', 'f@@', NULL, 11, 15, 1, 'a, b', NULL, '', '.helper .f## .load .run .rare%% _expr_.close .obj .open'), ('function', 'load', NULL, 16, 17, 1, 'a', 'dict[str, int]', '', ''), ('function', 'rare%%', NULL, 18, 19, 1, '', NULL, '', '.load'), ('function', 'run', 'K@@', 6, 7, 2, 'self, x: int, y: T', 'str', '', 'self.step .h .cached'), ('function', 'step', 'K@@', 8, 10, 4, 'self, y', NULL, '', 'json.dumps self.tool.use')) v(kind, name, owner, line, last, complexity, args, returns, bases, calls) WHERE (name <> 'load' OR k % 3 = 0) AND (name <> 'rare%%' OR k < 200))")
def scan_source_ast(t: Tables) -> DataFrame:
    calls = F.array_join(F.transform("calls", lambda c: F.concat(c["receiver"], F.lit("."), c["name"])), " ")
    return symbols.source_symbols(project(t), "path", "text").select("path", "kind", "name", "owner", "line", "last", "complexity", "args", "returns", "bases", calls.alias("calls"))


@query("j6_resolve_references", f"{_MEANT} SELECT source, receiver, name, target FROM r")
def resolve_references(t: Tables) -> DataFrame:
    """What every call of the project means: most names are those of very many functions."""
    return code_graph.resolved_calls(_found(t), "path").select("source", "receiver", "name", "target")


@query("j7_graph_ingest", f"{_MEANT} SELECT 'node' AS part, 'file' AS kind, path AS source, path AS target FROM p UNION ALL SELECT 'node', 'class', path || ':K' || k, path FROM p UNION ALL SELECT 'node', 'function', id, path FROM f UNION ALL SELECT 'edge', 'defines', path, path || ':K' || k FROM p UNION ALL SELECT 'edge', 'defines', path, id FROM f UNION ALL SELECT 'edge', 'inherits', path || ':K' || k, '__unresolved__:' || b FROM p, (VALUES ('Base'), ('pkg.Other')) v(b) UNION ALL SELECT 'edge', 'imports', path, '__import__:' || b FROM p, (VALUES ('json'), ('util')) v(b) UNION ALL SELECT DISTINCT 'edge', 'calls', source, target FROM r")
def graph_ingest(t: Tables) -> DataFrame:
    """Nodes and resolved edges of the project."""
    found = _found(t)
    nodes = code_graph.nodes(project(t), found, "path").select(F.lit("node").alias("part"), "kind", F.col("id").alias("source"), F.col("path").alias("target"))
    return nodes.unionByName(code_graph.edges(found, "path").select(F.lit("edge").alias("part"), "kind", "source", "target"))


@query("j9_code_impact", f"WITH RECURSIVE {_PROJECT}, r AS (SELECT k, 0 AS depth FROM p WHERE k = 5 UNION SELECT p.k, depth + 1 FROM r JOIN p ON p.k // 2 = r.k WHERE depth < 4) SELECT path || ':f' || r.k AS node, min(depth) AS depth FROM r JOIN p USING (k) GROUP BY 1")
def code_impact(t: Tables) -> DataFrame:
    """Who calls `f5`, directly or through others, by the resolved calls of the project."""
    found = _found(t)
    calls = code_graph.resolved_calls(found, "path").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    start = code_graph.nodes(project(t), found, "path").where("kind = 'function' AND name = 'f5'").select(F.col("id").alias("node"))
    return graph.distances(calls, start, 4, reverse=True)


@query("j20_dead_functions", f"WITH {_PROJECT} SELECT path, 'f' || k AS function, (n + 11)::INT AS line, 1::INT AS complexity, 5::INT AS lines FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS c WHERE c.k // 2 = p.k) ORDER BY path")
def dead_functions(t: Tables) -> DataFrame:
    """Functions of the project that nothing calls and no other file names: those of the later parts."""
    return code_graph.dead_functions(project(t), _found(t), "path", "text").orderBy(F.desc("complexity"), F.desc("lines"), "path")


#: Files to judge, and what is found: function, class, line, severity, confidence, mitigation.
GRADED = (
    ("@app.route('/x')\ndef page(q):\n    return eval(q, {\"__builtins__\": {}})\n",
     (("page", "missing_auth", 2, "HIGH", 0.6, None), ("page", "command_injection", 3, "LOW", 0.4, "restricted globals dict"))),
    ("@login_required\n@bp.route('/y')\ndef safe(q):\n    exec(q, safe_globals)\ndef raw(q):\n    eval(q + ')', (1))\n",
     (("safe", "command_injection", 4, "LOW", 0.4, "safe_globals"), ("raw", "command_injection", 6, "CRITICAL", 0.6, None))),
    ("class Box:\n    def make_id(self, x):\n        return hashlib.md5(x).hexdigest()\n    def sign(self, x):\n        a = hashlib.md5(x, usedforsecurity=False)\n        return hashlib.sha1(x)\n",
     (("Box.make_id", "weak_crypto", 3, "LOW", 0.4, None), ("Box.sign", "weak_crypto", 6, "MEDIUM", 0.6, None), ("<module>", "weak_crypto", 3, "MEDIUM", 0.8, None), ("<module>", "weak_crypto", 6, "MEDIUM", 0.8, None))),
    ("def outer(c):\n    def inner(d):\n        os.system(d)\n    s = \"os.system(x)\"  # eval(x)\n    return inner, f'{eval(x)}'\n",
     (("outer", "command_injection", 3, "CRITICAL", 0.6, None), ("inner", "command_injection", 3, "CRITICAL", 0.6, None))),
    ("password = \"abcdefghijkl1234\"\n# password = \"abcdefghijkl1234\"\ndef load(p):\n    return yaml.load(p)\n",
     (("<module>", "hardcoded_secret", 1, "HIGH", 0.8, None), ("load", "unsafe_deserialization", 4, "CRITICAL", 0.6, None))),
    ("token = 1\nsecret = \"abcdefghijkl1234\"\nhashlib.md5(x)\n", ()),
)


def _t39_sql() -> str:
    text = lambda v: "NULL" if v is None else "'" + v + "'"
    rows = ", ".join(f"({i}, {text(function)}, {text(kind)}, {line}, {text(severity)}, {confidence}, {text(mitigated)})" for i, (_, found) in enumerate(GRADED) for function, kind, line, severity, confidence, mitigated in found)
    return f"SELECT 'src/g' || p_partkey || '.py' AS path, function, class, (p_size % 4 + 1 + line)::INT AS line, severity, confidence::DOUBLE AS confidence, mitigated FROM part JOIN (VALUES {rows}) v(i, function, class, line, severity, confidence, mitigated) ON p_partkey % {len(GRADED)} = i"


@query("t39_graded_findings", _t39_sql())
def graded_findings(t: Tables) -> DataFrame:
    """Findings with the function they stand in, judged by their arguments, names and decorators; the last kind of file is a test."""
    head = F.repeat(F.concat(F.lit("# it's "), "p_name", F.lit("\f eval(x)\n")), (F.col("p_size") % 4 + 1).cast("int"))
    path = F.concat(_picked([F.lit("src/g")] * 5 + [F.lit("tests/g")]), "p_partkey", F.lit(".py"))
    files = _dealt(t.part).select(path.alias("path"), F.concat(head, _picked([F.lit(body) for body, _ in GRADED])).alias("text"))
    files = settled(files)  # else the scan's filter of texts would run before they are dealt
    return scan.graded(files, "path", "text", settled(symbols.source_symbols(files, "path", "text"))).drop("snippet")


def answers(t: Tables) -> DataFrame:
    """(p_partkey, text): what is said of every part's file."""
    k = F.col("p_partkey").cast("string")
    texts = (
        F.concat(F.lit("The `F"), k, F.lit("()` function is called.")),
        F.concat(F.lit("see class K"), k, F.lit(" and the k"), k, F.lit(" class")),
        F.concat(F.lit("f"), k, F.lit(" takes 2 parameters")),
        F.concat(F.lit("`f"), k, F.lit("()` takes 3 arguments")),
        F.concat(F.lit("It is in m"), k, F.lit(".py and from none"), k, F.lit(".py")),
        F.concat(F.lit("`load()` returns a "), F.when(F.col("p_partkey") % 4 == 1, "dict").otherwise("string")),
    )
    return _dealt(t.part).where("p_partkey >= 10").select("p_partkey", F.element_at(F.array(*texts), (F.col("p_partkey") % 6 + 1).cast("int")).alias("text"))


@query("t34_code_claims", "WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey >= 10) SELECT k AS p_partkey, 0::INT AS place, 'function' AS kind, 'F' || k AS name, '' AS detail FROM p WHERE k % 6 = 0 UNION ALL SELECT k, 0, 'class', 'K' || k, '' FROM p WHERE k % 6 = 1 UNION ALL SELECT k, 0, 'parameter_count', 'f' || k, '2' FROM p WHERE k % 6 = 2 UNION ALL SELECT k, 0, 'function', 'f' || k, '' FROM p WHERE k % 6 = 3 UNION ALL SELECT k, 1, 'parameter_count', 'f' || k, '3' FROM p WHERE k % 6 = 3 UNION ALL SELECT k, 0, 'file', 'm' || k || '.py', '' FROM p WHERE k % 6 = 4 UNION ALL SELECT k, 1, 'file', 'none' || k || '.py', '' FROM p WHERE k % 6 = 4 UNION ALL SELECT k, 0, 'function', 'load', '' FROM p WHERE k % 6 = 5 UNION ALL SELECT k, 1, 'return_type', 'load', CASE WHEN k % 4 = 1 THEN 'dict' ELSE 'string' END FROM p WHERE k % 6 = 5")
def code_claims(t: Tables) -> DataFrame:
    """Claims of five kinds."""
    return claims.extracted(answers(t), "p_partkey", "text")


@query("m16_code_claims", f"WITH {_PROJECT}, {_FUNCTIONS}, l AS (SELECT min(path) AS path FROM f WHERE name = 'load'), c AS (SELECT k, 'function' AS kind, 'F' || k AS name, 'corrected' AS status, 'f' || k AS known FROM p WHERE k % 6 = 0 UNION ALL SELECT k, 'class', 'K' || k, 'verified', path FROM p WHERE k % 6 = 1 UNION ALL SELECT k, 'parameter_count', 'f' || k, 'verified', '2' FROM p WHERE k % 6 = 2 UNION ALL SELECT k, 'function', 'f' || k, 'verified', path FROM p WHERE k % 6 = 3 UNION ALL SELECT k, 'parameter_count', 'f' || k, 'corrected', '2' FROM p WHERE k % 6 = 3 UNION ALL SELECT k, 'file', 'm' || k || '.py', 'verified', path FROM p WHERE k % 6 = 4 UNION ALL SELECT k, 'file', 'none' || k || '.py', NULL, NULL FROM p WHERE k % 6 = 4 UNION ALL SELECT k, 'function', 'load', 'verified', l.path FROM p, l WHERE k % 6 = 5 UNION ALL SELECT k, 'return_type', 'load', CASE WHEN k % 4 = 1 THEN 'verified' ELSE 'corrected' END, 'dict[str, int]' FROM p WHERE k % 6 = 5) SELECT k AS p_partkey, kind, name, status, known FROM c WHERE k >= 10")
def verified_claims(t: Tables) -> DataFrame:
    """The claims held against the project: names in the wrong case, numbers of arguments, results, files."""
    found = _found(t)
    return claims.verified(claims.extracted(answers(t), "p_partkey", "text"), found, project(t), "path").select("p_partkey", "kind", "name", "status", "known")


@query("m17_code_context", f"{_MEANT}, e AS (SELECT DISTINCT source, target FROM r JOIN f ON f.id = target WHERE source <> target), a AS (SELECT source AS id, list(target ORDER BY target)[1:8] AS callees FROM e GROUP BY 1), b AS (SELECT target AS id, list(source ORDER BY source)[1:8] AS callers FROM e GROUP BY 1) SELECT f.id, f.path, coalesce(callers, []) AS callers, coalesce(callees, []) AS callees FROM f LEFT JOIN a USING (id) LEFT JOIN b USING (id)")
def code_context(t: Tables) -> DataFrame:
    """Every function of the project with the first of those that call it and that it calls."""
    return code_graph.contexts(_found(t), "path", 8).select("id", "path", "callers", "callees")


_ENTITIES = ("f12", "rare7", "k77", "m33", "step")


@query("j17_code_retriever", f"{_MEANT}, n AS (SELECT path AS id, 'file' AS kind, 'm' || k || '.py' AS name, path FROM p UNION ALL SELECT path || ':K' || k, 'class', 'K' || k, path FROM p UNION ALL SELECT id, 'function', CASE WHEN owner IS NULL THEN name ELSE owner || '.' || name END, path FROM f), e AS (SELECT unnest([{', '.join(repr(x) for x in _ENTITIES)}]) AS e), d AS (SELECT DISTINCT name FROM n, e WHERE kind = 'function' AND (lower(name) = e OR ends_with(lower(name), '.' || e) OR starts_with(lower(name), e))), cl AS (SELECT DISTINCT name FROM n, e WHERE kind = 'class' AND contains(lower(name), e)), fl AS (SELECT DISTINCT path FROM n, e WHERE kind = 'file' AND contains(replace(name, '.py', ''), e)), q AS (SELECT DISTINCT a.name AS caller, b.name AS callee FROM r JOIN n a ON a.id = r.source JOIN n b ON b.id = r.target), s AS (SELECT name FROM d UNION SELECT split_part(name, '.', -1) FROM d), w AS (SELECT caller AS name FROM q WHERE callee IN (SELECT name FROM s) OR split_part(callee, '.', -1) IN (SELECT name FROM s) UNION SELECT callee FROM q WHERE caller IN (SELECT name FROM d)), pt AS (SELECT DISTINCT substring(split_part(name, '.', -1), 1, i) AS name FROM d, range(1, 9) g(i) WHERE contains(name, '.')) SELECT id, kind, name, path, (CASE WHEN name IN (SELECT name FROM d) THEN 1.0 WHEN name IN (SELECT name FROM pt) THEN 0.9 WHEN name IN (SELECT name FROM cl) THEN 0.85 WHEN contains(name, '.') AND split_part(name, '.', 1) IN (SELECT name FROM cl) THEN 0.75 WHEN path IN (SELECT path FROM fl) THEN 0.65 ELSE 0.5 END)::DOUBLE AS score FROM n WHERE name IN (SELECT name FROM d) OR name IN (SELECT name FROM pt) OR name IN (SELECT name FROM cl) OR contains(name, '.') AND split_part(name, '.', 1) IN (SELECT name FROM cl) OR path IN (SELECT path FROM fl) OR name IN (SELECT name FROM w)")
def code_retriever(t: Tables) -> DataFrame:
    """What the names of a question lead to in the project's graph."""
    return code_graph.retrieved(project(t), _found(t), "path", list(_ENTITIES))
