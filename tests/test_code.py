"""Scans of source text, symbols of many languages, and what calls refer to."""

import random

import pytest

from tessera.operators import code_graph, scan
from tessera.plans.code_queries import FILES
from tessera.sources import symbols


@pytest.mark.parametrize(
    ("source", "clean"),
    [
        ("x = '\x0c'\ny = 'abc'\n", "x = ' '\ny = '   '\n"),
        ("print(f'eval(x)')", "print(f'       ')"),
        ("print(f\"{os.system('x')}\")", 'print(f"' + " " * 16 + '")'),
        ("a = 1 # it's \r 'x'\nb = 'c'", "a = 1 " + " " * 12 + "\nb = ' '"),
        ("s = 'it\\'s' + \"#\" # '", "s = '     ' + \" \"    "),
        ('d = """a \'q\' # "\n""x\n"""\n', 'd = """         \n   \n"""\n'),
        ("e = 'open\nf = 1", "e = '    \nf = 1"),
        ("g = '''never closed \n eval(x)", "g = '''             \n        "),
        ("h = 'a\\\nb'", "h = '  \n '"),
        ("'", "'"), ("\"\"", "\"\""), ('"""', '"""'), ("'\\", "' "), ("", ""),
        ("u = 'a\u2028b'", "u = '   '"),
    ],
)
def test_blanked(source, clean):
    assert scan.blank_literals(source) == clean


def test_blanked_by_signs():
    """The same, sign by sign."""
    rng = random.Random(5)
    for _ in range(2000):
        source = "".join(rng.choice("'\"#\\\n\r\x0cab ") for _ in range(rng.randrange(25)))
        assert scan.blank_literals(source) == automaton(source), source


def automaton(source):
    out, i = "", 0
    while i < len(source):
        three, one = source[i : i + 3], source[i]
        if one == "#":
            state, quote = "comment", ""
        elif three in ("'''", '"""'):
            state, quote = "long", three
        elif one in "'\"":
            state, quote = "short", one
        else:
            out, i = out + one, i + 1
            continue
        out, i = out + quote, i + len(quote)
        while i < len(source):
            if state == "comment" and source[i] == "\n":
                break
            if quote and source.startswith(quote, i):
                out, i = out + quote, i + len(quote)
                break
            if state == "short" and source[i] == "\n":
                out, i = out + "\n", i + 1
                break
            step = 2 if state == "short" and source[i] == "\\" and i + 1 < len(source) else 1
            out, i = out + "".join("\n" if c == "\n" else " " for c in source[i : i + step]), i + step
    return out


def test_findings_lines(spark):
    files = spark.createDataFrame([("a.py", "a = 1\x0cb\nos.system(c)\n"), ("b.py", "x = '\x0c'\ny = 'eval(z)'\r\neval(q)\n"), ("c.py", "s = 'a\u2028b'\n# os.system(x)\n  eval(z)"), ("d.py", None)], "path string, text string")
    got = sorted((r.path, r["class"], r.line, r.snippet) for r in scan.findings(files, "path", "text").collect())
    assert got == [("a.py", "command_injection", 2, "os.system(c)"), ("b.py", "command_injection", 3, "eval(q)"), ("c.py", "command_injection", 3, "eval(z)")]


@pytest.mark.parametrize("language", [f[0] for f in FILES])
def test_rules(language):
    """Every language: lines by places, whatever stands above; owners, arguments, returns and bases."""
    _, body, want = next(f for f in FILES if f[0] == language)
    for head in ("", "// Cq fq\x0c x\n\n", "// fq\r\n"):
        shift = head.count("\n")
        got = [(s["kind"], s["name"], s["line"], s["last"] - s["line"], s.get("owner"), ",".join(s["args"]), s.get("returns"), ",".join(s["bases"])) for s in symbols.symbols_of(f"a/b.{language}", head + body.replace("@@", "q"))]
        fill = lambda v: v.replace("@@", "q") if isinstance(v, str) else v
        assert got == [tuple(map(fill, (kind, name, line + shift, *rest))) for kind, name, line, *rest in want]


def test_rules_of_several():
    """Two functions of one name have lines of their own; key words are none; a name of signs is no pattern."""
    got = [(s["name"], s["line"]) for s in symbols.symbols_of("x.js", "// g g\nfunction g() {}\nif (a) {}\nlet g = () => 1\n")]
    assert got == [("g", 2), ("g", 4)]
    lua = symbols.symbols_of("x.lua", "Mxf()\nfunction M.f()\n")
    assert [(s["name"], s["line"]) for s in lua] == [("M.f", 2)]
    assert symbols.symbols_of("x.js", None) == symbols.symbols_of(None, "") == symbols.symbols_of("x", "") == []


def test_python_symbols():
    source = '''import os, a.b as c
from . import d
from e.f import g as h, i
TOP, low = 1, 2
MAX = 3
class A(B, m.C, fn()):
    LIMIT = 1
    @staticmethod
    def f(self, x: "T", y: list[int] = 1) -> dict[str, int]:
        def inner(): return g().h(1)
        return self.p.q(x) if x and y or self else [z for z in y]
    async def k(self) -> "A": pass
'''
    got = {(s["kind"], s["name"]): s for s in symbols.python_symbols_of(source)}
    f = got["function", "f"]
    assert (f["owner"], f["line"], f["last"], f["returns"], f["decorators"]) == ("A", 9, 11, "dict[str, int]", ["staticmethod"])
    assert f["complexity"] == 1 + 2 + 1 and f["args"][:2] == ["self", "x: T"] and f["args"][2].startswith("y: Subscript")
    assert [(c["receiver"], c["name"]) for c in f["calls"]] == [("_expr_", "h"), ("", "g"), ("self.p", "q")]
    assert got["function", "inner"]["owner"] is None and got["function", "k"]["returns"] == "A"
    assert got["class", "A"]["bases"] == ["B", "m.C"] and got["class", "A"]["names"] == ["f", "k"]
    assert got["import", "a.b"]["alias"] == "c" and got["import", "e.f"]["names"] == ["g", "i"] and got["import", ""]["is_from"]
    assert ("global", "MAX") in got and ("global", "LIMIT") in got and ("global", "TOP") not in got
    assert symbols.symbols_of("x.py", "def (") == []


def meant(functions, imports, call):
    """What a call means, by the rules one after another."""
    path, owner, receiver, name = call
    look = name if receiver == "" else None if receiver in ("self", "cls") else receiver.split(".")[0]
    if look is not None and (look in imports.get(path, ()) or look in code_graph.EXTERNAL):
        return "__external__:" + (f"{receiver}.{name}" if receiver else name)
    found = [f for f in functions if f[1] == name]
    here = [f for f in found if f[2] == path]
    pick = None
    if receiver in ("self", "cls"):
        own = [f for f in here if f[3] == owner and owner is not None]
        pick = (own or here or [None])[0]
    elif len(found) == 1 or here:
        pick = (here or found)[0]
    elif found:
        folder, top = path.rpartition("/")[0], path.split("/")[0] if "/" in path else path.rsplit(".", 1)[0]
        top_of = lambda f: f[2].split("/")[0] if "/" in f[2] else f[2].rsplit(".", 1)[0]
        near = [f for f in found if f[2].rpartition("/")[0] == folder]
        own = [f for f in found if top_of(f) == top]
        if near:
            pick = near[0]
        elif len(found) <= 5:
            pick = (own[0] if len(own) == 1 else None) if {top_of(f) for f in found} - {top} else found[0]
    return pick[0] if pick else f"__unresolved__:{name}"


def test_resolved_calls(spark):
    rng = random.Random(3)
    folders = ["", "a/", "a/x/", "b/", "b/y/"]
    files = []
    for i in range(60):
        lines = [rng.choice(["import json", "from q import helper", "import z.w as v", ""])]
        if rng.random() < 0.7:
            lines += ["class K:"] + [f"    def m{rng.randrange(6)}{j}(self):\n        self.m{rng.randrange(6)}{rng.randrange(2)}()" for j in range(2)]
        for j in range(3):
            lines += [f"def f{rng.randrange(25)}():", *(f"    {rng.choice(['', 'self.', 'json.', 'v.', 'z.', 'other.', 'x().'])}{rng.choice(['f', 'm'])}{rng.randrange(25)}()" for _ in range(4)), "    helper(); hot(); os()"]
        if i % 2:
            lines += ["def hot(): pass"]
        files.append((f"{rng.choice(folders)}n{i}.py", "\n".join(lines)))
    df = spark.createDataFrame(files, "path string, text string")
    found = symbols.source_symbols(df, "path", "text")
    functions, imports, calls = [], {}, set()
    for path, text in sorted(files):
        for s in symbols.symbols_of(path, text):
            if s["kind"] == "function":
                whole = f"{s['owner']}.{s['name']}" if s.get("owner") else s["name"]
                if not any(f[0] == f"{path}:{whole}" for f in functions):
                    functions.append((f"{path}:{whole}", s["name"], path, s.get("owner")))
                calls |= {(f"{path}:{whole}", path, s.get("owner"), c["receiver"], c["name"]) for c in s["calls"]}
            elif s["kind"] == "import":
                parts = s["name"].split(".")
                imports.setdefault(path, set()).update([".".join(parts[: i + 1]) for i in range(len(parts))], s["names"], [s["alias"]] if s.get("alias") else [])
    got = code_graph.resolved_calls(found, "path").collect()
    assert {(r.source, r.receiver, r.name, r.target) for r in got} == {(source, receiver, name, meant(functions, imports, (path, owner, receiver, name))) for source, path, owner, receiver, name in calls}
    assert len(got) == len(calls)  # a row a call, though half the files define `hot`


def test_edges(spark):
    files = [("a.py", "from b import helper\nclass Dog(Animal): pass\nclass Cat(Dog2, helper): pass\ndef main():\n    helper(); helper(); there()\n"), ("b.py", "def helper(): pass\ndef there(): helper()\n"), ("c.go", "import \"fmt\"\nfunc main(a int) {\n"), ("d.txt", None)]
    df = spark.createDataFrame(files, "path string, text string")
    found = symbols.source_symbols(df, "path", "text")
    got = {(r.source, r.kind, r.target, r.sites) for r in code_graph.edges(found, "path").collect()}
    assert {("a.py", "imports", "__import__:b", 1), ("a.py:main", "calls", "__external__:helper", 2), ("a.py:main", "calls", "b.py:there", 1), ("b.py:there", "calls", "b.py:helper", 1), ("a.py:Dog", "inherits", "__unresolved__:Animal", 1), ("a.py:Cat", "inherits", "b.py:helper", 1), ("c.go", "defines", "c.go:main", 1), ("c.go", "imports", "__import__:fmt", 1)} <= got
    nodes = {(r.id, r.kind, r.name) for r in code_graph.nodes(df, found, "path").collect()}
    assert {("d.txt", "file", "d.txt"), ("a.py:Dog", "class", "Dog"), ("c.go:main", "function", "main")} <= nodes
    empty = symbols.source_symbols(df.where("false"), "path", "text")
    assert code_graph.edges(empty, "path").count() == 0


def test_top_package(spark):
    from pyspark.sql import functions as F

    paths = {"a/b/c.py": "a", "c.py": "c", "/x/y.py": "x", "./p/q.py": "p", "C:\\w\\v.py": "w", "": "", "noext": "noext"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.t for r in df.select("p", code_graph.top_package(F.col("p")).alias("t")).collect()} == paths


def test_call_arguments():
    assert scan.call_arguments("eval(a, (b), ')', \"(\\\"\")", 0) == "a, (b), ')', \"(\\\"\""
    assert scan.call_arguments("eval", 0) == scan.call_arguments("x" * 90 + "(a)", 0) == ""
    assert scan.call_arguments("f(" + "a" * 700 + ")", 0) == "a" * 598


def test_graded(spark):
    files = [
        ("a.py", "class C:\n    @r.get('/x')\n    def f(self): pass\n    @r.route('/y')\n    @jwt_required()\n    def g(self): pass\n    @app.route('/z')\n    def h(self):\n        return subprocess.run(x, shell=True), eval('x', {'__builtins__' : None})\n"),
        ("test/b.py", "key = 'AKIA" + "A" * 16 + "'\ndef f(): return hashlib.md5(1)\n"),
        ("c.py", None),
        ("d.js", "function run(a) {\n  x.innerHTML = a\n}\n"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {(r.path, r.function, r["class"], r.line, r.severity, r.mitigated) for r in scan.graded(df, "path", "text", symbols.source_symbols(df, "path", "text")).collect()}
    assert got == {
        ("a.py", "C.h", "missing_auth", 8, "HIGH", None),
        ("a.py", "C.h", "command_injection", 9, "CRITICAL", None),
        ("test/b.py", "f", "weak_crypto", 2, "MEDIUM", None),
        ("d.js", "run", "xss", 2, "HIGH", None),
    }


def test_dead_functions(spark):
    files = [
        ("a.py", "def used(): pass\ndef dead(): pass\ndef named(): pass\ndef _own(): pass\ndef __x__(): pass\ndef main(): used()\n@app.route('/')\ndef page(): pass\nTABLE = {'own2': own2}\ndef own2(): pass\n"),
        ("b.py", "HANDLERS = ['named']\ndef twice(): pass\n"),
        ("c.py", "def twice(): pass\n"),
        ("tests/t.py", "def helper(): pass\n"),
        ("d.py", None),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    found = symbols.source_symbols(df, "path", "text")
    got = {(r.path, r.function, r.line, r.lines) for r in code_graph.dead_functions(df, found, "path", "text").collect()}
    assert got == {("a.py", "dead", 2, 1), ("a.py", "_own", 4, 1), ("a.py", "own2", 10, 1)}
    assert {r.function for r in code_graph.dead_functions(df, found, "path", "text", private_too=False).collect()} == {"dead", "own2"}
