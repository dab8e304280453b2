"""The project of the parts: its files are dealt to tasks, and symbols are read from each file once."""

import ast
import os
import random

import pytest

from tessera.plans import code_queries, registry
from tessera.sources import symbols

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    return registry.Tables(spark, DATA)


def test_files_are_dealt(tables, monkeypatch):
    """One file of parts, read by one task, is parsed by several."""
    monkeypatch.setattr(code_queries, "TASK", 50)
    files = code_queries.project(tables)
    sizes = files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == tables.part.count() and len([n for n in sizes if n]) >= 3 and max(sizes) <= 100


def test_one_walk():
    """Calls and branches as by the walks of the standard library, in their order, for all kinds of nodes."""
    source = '''
def f(*a: g(), b=h(), **c: i()):
    match a:
        case X(y=1) if k(): p()
        case [1, *z]: pass
    with o() as r, s.t(): pass
    d = {**u, "b": v(w), **x(1)}
    async def inner(): return [y async for y in q() if z() and r() or s()]
    try: pass
    except* E(): aa()
    while 1 and 2: bb(*cc(), d=dd())
    return (lambda: ee() if ff else gg(), f"{hh(x)!r:{ii()}}")
'''
    top = ast.parse(source).body[0]
    calls, stack = [], [top]
    while stack:
        node = stack.pop()
        if isinstance(node, ast.Call):
            calls.append(node.func.id if isinstance(node.func, ast.Name) else node.func.attr)
        stack.extend(reversed(list(ast.iter_child_nodes(node))))
    branches = 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.comprehension)) for n in ast.walk(top))
    got = symbols.python_symbols_of(source)
    assert [s["name"] for s in got] == ["f", "inner"]
    assert [c["name"] for c in got[0]["calls"]] == calls and len(calls) == 22 and got[0]["complexity"] == branches


def test_columns(spark):
    """Symbols with no, one and many calls keep theirs when columns are made of a batch."""
    rng = random.Random(3)
    counts = [rng.randrange(4) for _ in range(60)] + [0, 200]
    files = spark.createDataFrame([(f"a{i}.py", "".join(f"def f{k}():\n    g{k}(x.y{k}())\n" for k in range(n))) for i, n in enumerate(counts)] + [("none.py", None), ("a.go", "func F(a int) {\n")], "path string, text string").repartition(3)
    got = symbols.source_symbols(files, "path", "text").collect()
    assert len(got) == sum(counts) + 1
    for s in got:
        n = s.name[1:]
        assert [tuple(c) for c in s.calls] == ([("", f"g{n}"), ("x", f"y{n}")] if s.path != "a.go" else [])
        assert s.place == (int(n) if s.path != "a.go" else 0)


@pytest.mark.parametrize("name", ["j6_resolve_references", "j7_graph_ingest", "j9_code_impact", "j17_code_retriever", "j20_dead_functions", "m17_code_context"])
def test_parsed_once(tables, name):
    """What a query reads is the written symbols: its plan parses no file again."""
    plan = registry.load()[name].run(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Relation" in plan


def test_claims_parsed_once(tables):
    plan = registry.load()["m16_code_claims"].run(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "place#" in plan and plan.count("MapInArrow") <= 1  # the answers' claims


def test_graded_is_merged(tables):
    """Neither the functions nor the matches are broadcast, though the table that files are made of is small; each is read once."""
    plan = registry.load()["t39_graded_findings"].run(tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "MapInArrow" not in plan


def test_claims_are_merged(tables):
    """The ends of all files' names are not broadcast, though the table that they are made of is small."""
    plan = registry.load()["m16_code_claims"].run(tables)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 3
