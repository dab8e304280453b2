"""Claims about code, extracted and held against a small project."""

from tessera.operators import claims, code_graph
from tessera.sources import symbols


def test_claims_of():
    text = "The `parse()` function takes text. Use the print function. `Parse` class; class thing. load_all accepts 2 arguments, `gogo()` takes 1 parameter. It is in core.py and `util.py`. `gogo()` returns a list."
    kinds = {c[1:] for c in claims.claims_of(text)}
    assert {("function", "parse", ""), ("class", "Parse", ""), ("parameter_count", "load_all", "2"), ("parameter_count", "gogo", "1"), ("file", "core.py", ""), ("file", "util.py", ""), ("return_type", "gogo", "list")} <= kinds
    assert not any(name in ("print", "thing") for _, name, _ in kinds)
    assert len(claims.claims_of(" ".join(f"`name{i}()`" for i in range(30)))) == claims.MOST and claims.claims_of(None) == []


def test_verified(spark):
    files = spark.createDataFrame([("a/core.py", "class Store:\n    def load(self, a): pass\ndef go(x, y) -> dict: pass\ndef none(): pass\n"), ("b/score.py", "def go(x): pass\n"), ("c.py", None)], "path string, text string")
    found = symbols.source_symbols(files, "path", "text")
    said = spark.createDataFrame([(1, 0, *c) for c in [("function", "go", ""), ("function", "GO", ""), ("function", "gone", ""), ("function", "Store.load", ""), ("class", "store", ""), ("class", "Store", ""), ("parameter_count", "go", "2"), ("parameter_count", "Go", "3"), ("parameter_count", "none", "1"), ("return_type", "go", "Dict"), ("return_type", "go", "list"), ("file", "core.py", ""), ("file", "re.py", ""), ("file", "x.py", "")]], "k int, place int, kind string, name string, detail string")
    got = {(r.kind, r.name, r.detail): (r.status, r.known) for r in claims.verified(said, found, files, "path").collect()}
    assert got == {
        ("function", "go", ""): ("verified", "a/core.py"), ("function", "GO", ""): ("corrected", "go"), ("function", "gone", ""): (None, None), ("function", "Store.load", ""): ("verified", "a/core.py"),
        ("class", "store", ""): ("corrected", "Store"), ("class", "Store", ""): ("verified", "a/core.py"),
        ("parameter_count", "go", "2"): ("verified", "2"), ("parameter_count", "Go", "3"): ("corrected", "2"), ("parameter_count", "none", "1"): (None, None),
        ("return_type", "go", "Dict"): ("verified", "dict"), ("return_type", "go", "list"): ("corrected", "dict"),
        ("file", "core.py", ""): ("verified", "a/core.py"), ("file", "re.py", ""): ("verified", "a/core.py"), ("file", "x.py", ""): (None, None),
    }


def test_contexts(spark):
    files = spark.createDataFrame([("m.py", "def hub(): pass\n" + "".join(f"def f{i:02d}():\n    hub(); lone{i}()\n" for i in range(12)))], "path string, text string")
    got = {r.id: r for r in code_graph.contexts(symbols.source_symbols(files, "path", "text"), "path", 3).collect()}
    assert got["m.py:hub"].callers == ["m.py:f00", "m.py:f01", "m.py:f02"] and got["m.py:hub"].callees == []
    assert got["m.py:f05"].callees == ["m.py:hub"] and len(got) == 13
