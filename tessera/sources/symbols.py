"""Symbols of source files: functions, classes, imports and globals, in one pass over Arrow batches.

Python files go through the parser of the standard library; files of other
languages through the rules of their language, or the general rules.  A rule's
matches carry their places in the text, and a list of the text's line feeds
turns places into lines, so a name that stands elsewhere too does no harm.
"""

from __future__ import annotations

import ast
import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

_TEXTS = ArrayType(StringType())
#: What is known of a symbol.  owner: a method's class; calls: receiver (empty for a bare name) and name of each call; names: what `from` imports.
SYMBOL = StructType([
    StructField("kind", StringType()), StructField("name", StringType()), StructField("owner", StringType()), StructField("line", IntegerType()), StructField("last", IntegerType()),
    StructField("complexity", IntegerType()), StructField("args", _TEXTS), StructField("returns", StringType()), StructField("bases", _TEXTS), StructField("decorators", _TEXTS),
    StructField("is_method", BooleanType()), StructField("is_from", BooleanType()), StructField("names", _TEXTS), StructField("alias", StringType()),
    StructField("calls", ArrayType(StructType([StructField("receiver", StringType()), StructField("name", StringType())]))),
])


def _symbol(kind: str, name: str, line: int, last: int, **more: object) -> dict:
    return {"kind": kind, "name": name, "line": line, "last": last, "complexity": 1, "args": [], "bases": [], "decorators": [], "is_method": False, "is_from": False, "names": [], "calls": []} | more


# ---------------------------------------------------------------- Python


def _receiver(node: ast.AST) -> str:
    """What a method is called on, as dotted names, or `_expr_`."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else "_expr_"


def _fields(*kinds: type) -> dict[type, tuple[str, ...]]:
    """Of every class of nodes, the fields that can hold nodes of some kinds, in their order; where Python does not say what a field holds, all."""

    def holds(kind: object) -> bool:
        return any(isinstance(k, type) and issubclass(k, kinds) for k in (kind, *getattr(kind, "__args__", ())))

    nodes = [c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)]
    return {c: tuple(f for f in c._fields if not (types := getattr(c, "_field_types", None)) or holds(types[f])) for c in nodes}


#: Where nodes can stand that call or branch, and where statements can: no expression holds a statement.
_INNER = _fields(ast.stmt, ast.expr, ast.excepthandler, ast.comprehension, ast.arguments, ast.arg, ast.keyword, ast.match_case, ast.pattern, ast.withitem, getattr(ast, "type_param", ast.stmt))
_BODIES = _fields(ast.stmt, ast.excepthandler, ast.match_case)


def _within(node: ast.AST, fields: tuple[str, ...]) -> list[ast.AST]:
    out: list[ast.AST] = []
    for f in fields:
        held = getattr(node, f, None)
        if held.__class__ is list:
            out += held
        elif held is not None:
            out.append(held)
    return out


_BRANCHES = frozenset((ast.If, ast.For, ast.While, ast.ExceptHandler, ast.comprehension))


def _walked(function: ast.AST) -> tuple[list[dict[str, str]], int]:
    """Receiver and name of every call in a function, functions within it included, outer calls first; and one more than its branches: if, for, while, handlers, parts of comprehensions, and further operands of and/or."""
    out, stack, branches = [], [function], 1
    while stack:
        node = stack.pop()
        kind = type(node)
        if kind is ast.Call:
            if isinstance(node.func, ast.Name):
                out.append({"receiver": "", "name": node.func.id})
            elif isinstance(node.func, ast.Attribute):
                out.append({"receiver": _receiver(node.func.value), "name": node.func.attr})
        elif kind is ast.BoolOp:
            branches += len(node.values) - 1
        elif kind in _BRANCHES:
            branches += 1
        if fields := _INNER.get(kind):
            inner = _within(node, fields)
            inner.reverse()
            stack += inner
    return out, branches


def _said(annotation: ast.AST | None, other: str) -> str | None:
    if annotation is None:
        return None
    if isinstance(annotation, ast.Name):
        return annotation.id
    if isinstance(annotation, ast.Constant):
        return str(annotation.value)
    return ast.unparse(annotation) if other == "text" else ast.dump(annotation)


def _decorators(node: ast.AST) -> list[str]:
    heads = [d.func if isinstance(d, ast.Call) else d for d in node.decorator_list]
    return [h.id if isinstance(h, ast.Name) else h.attr for h in heads if isinstance(h, (ast.Name, ast.Attribute))]


def python_symbols_of(source: str) -> list[dict]:
    """The symbols of a Python file, nested ones included; none if it cannot be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[dict] = []
    level: list[tuple[ast.AST, str | None]] = [(tree, None)]  # a node, and the class whose body it stands in
    while level:
        below: list[tuple[ast.AST, str | None]] = []
        for node, owner in level:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = [a.arg if a.annotation is None else f"{a.arg}: {_said(a.annotation, 'tree')}" for a in node.args.args]
                calls, branches = _walked(node)
                out.append(_symbol("function", node.name, node.lineno, node.end_lineno, owner=owner, is_method=owner is not None, complexity=branches, args=args, returns=_said(node.returns, "text"), decorators=_decorators(node), calls=calls))
            elif isinstance(node, ast.ClassDef):
                bases = [ast.unparse(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
                methods = [x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
                out.append(_symbol("class", node.name, node.lineno, node.end_lineno, bases=bases, names=methods, decorators=_decorators(node)))
            elif isinstance(node, ast.Import):
                out += [_symbol("import", a.name, node.lineno, node.lineno, alias=a.asname) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out.append(_symbol("import", node.module or "", node.lineno, node.lineno, is_from=True, names=[a.name for a in node.names]))
            elif isinstance(node, ast.Assign):
                out += [_symbol("global", x.id, node.lineno, node.lineno) for x in node.targets if isinstance(x, ast.Name) and x.id.isupper()]
            if fields := _BODIES.get(type(node)):
                of = node.name if isinstance(node, ast.ClassDef) else None
                below += [(c, of) for c in _within(node, fields)]
        level = below
    return out


# ---------------------------------------------------------------- other languages


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind of symbol; the rest says which groups hold what.

    steps: what is done to each argument: split at a text and keep one part;
    without: signs that are dropped from it; span: lines that a symbol is taken
    to last; skip: names that are no symbols; head: characters that are searched.
    """

    languages: tuple[str, ...]
    kind: str
    pattern: str
    name: int = 1
    args: int = 0
    steps: tuple[tuple[str, int], ...] = ()
    without: str = ""
    owner: int = 0
    bases: tuple[int, ...] = ()
    returns: int = 0
    span: int = 10
    skip: tuple[str, ...] = ()
    method: bool = False
    head: int = 0
    flags: int = 0
    once: str = ""  # per line: not where the same name was found on a line; per text: each name once

    def arguments(self, said: str | None) -> list[str]:
        out = []
        for a in (said or "").split(","):
            a = a.strip()
            if not a:
                continue
            for sep, k in self.steps:
                a = a.split(sep)[k].strip()
            out.append("".join(c for c in a if c not in self.without))
        return out


_JS = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "vue", "svelte")
_JAVA = ("java", "kt", "kts", "scala", "groovy")
_C = ("c", "cpp", "h", "hpp", "cc", "cxx", "hh", "cs", "m", "mm")
_EX, _SH = ("ex", "exs"), ("sh", "bash", "zsh", "fish")
_NO = ("if", "for", "while", "switch", "catch", "class")
#: The rules of every language.  Patterns, skipped names and spans are fixed values.
RULES = (
    Rule(_JS, "function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)", args=2, steps=((":", 0),), span=5),
    Rule(_JS, "function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*=>", args=2, steps=((":", 0),), span=5),
    Rule(_JS, "function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function\s*\(([^)]*)\)", args=2, steps=((":", 0),), span=5),
    Rule(_JS, "function", r"(?:async\s+)?(\w+)\s*\(([^)]*)\)\s*\{", args=2, steps=((":", 0),), span=5, skip=("if", "for", "while", "switch", "catch", "function"), method=True, once="line"),
    Rule(_JS, "class", r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?", bases=(2,)),
    Rule(_JS, "import", r"import\s+.*?from\s+['\"]([^'\"]+)['\"]"),
    Rule(_JS, "import", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    Rule(("go",), "function", r"func\s+(\w+)\s*\(([^)]*)\)(?:\s*\(?([^)]*)\)?)?", args=2, steps=((" ", 0),), returns=3),
    Rule(("go",), "function", r"func\s+\(\s*\w+\s+\*?(\w+)\s*\)\s+(\w+)\s*\(([^)]*)\)", name=2, args=3, steps=((" ", 0),), owner=1, method=True),
    Rule(("go",), "class", r"type\s+(\w+)\s+struct\s*\{"),
    Rule(("go",), "class", r"type\s+(\w+)\s+interface\s*\{"),
    Rule(("go",), "import", r"\"([^\"]+)\"", head=500),
    Rule(("rs",), "function", r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)(?:\s*->\s*(\S+))?", args=2, steps=((":", 0),), returns=3),
    Rule(("rs",), "class", r"(?:pub\s+)?struct\s+(\w+)"),
    Rule(("rs",), "class", r"(?:pub\s+)?enum\s+(\w+)"),
    Rule(("rs",), "class", r"(?:pub\s+)?trait\s+(\w+)"),
    Rule(("rs",), "import", r"use\s+([\w:]+)"),
    Rule(_JAVA, "class", r"(?:public|private|protected)?\s*(?:abstract\s+)?(?:class|interface)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?", bases=(2, 3), span=20),
    Rule(_JAVA, "function", r"(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(\w+)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+\w+)?\s*\{", name=2, args=3, steps=((" ", -1),), returns=1, skip=_NO, method=True),
    Rule(_JAVA, "import", r"import\s+([\w.]+);"),
    Rule(_C, "function", r"(?:static\s+)?(?:inline\s+)?(\w+)\s+(\w+)\s*\(([^)]*)\)\s*\{", name=2, args=3, steps=((" ", -1),), without="*&", returns=1, skip=("if", "for", "while", "switch", "catch", "return", "sizeof")),
    Rule(_C, "class", r"(?:class|struct)\s+(\w+)(?:\s*:\s*(?:public|private|protected)?\s*(\w+))?", bases=(2,)),
    Rule(_C, "import", r"#include\s*[<\"]([^>\"]+)[>\"]"),
    Rule(("sql",), "function", r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION)\s+(\w+)\s*\(([^)]*)\)", args=2, steps=((" ", 0),), flags=re.IGNORECASE),
    Rule(("sql",), "class", r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)", flags=re.IGNORECASE),
    Rule(("rb",), "function", r"def\s+(?:self\.)?(\w+)(?:\(([^)]*)\))?", args=2, span=5),
    Rule(("rb",), "class", r"(?:class|module)\s+(\w+)(?:\s*<\s*(\w+))?", bases=(2,)),
    Rule(("php",), "function", r"(?:public|private|protected)?\s*(?:static\s+)?function\s+(\w+)\s*\(([^)]*)\)", args=2, steps=(("=", 0), (" ", -1)), without="$"),
    Rule(("php",), "class", r"class\s+(\w+)(?:\s+extends\s+(\w+))?", bases=(2,)),
    Rule(("swift",), "function", r"(?:public\s+|private\s+|internal\s+)?(?:static\s+)?func\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*(\S+))?", args=2, steps=((":", 0),), returns=3),
    Rule(("swift",), "class", r"(?:class|struct|protocol|enum)\s+(\w+)(?:\s*:\s*(\w+))?", bases=(2,)),
    Rule(("dart",), "function", r"(?:Future<\w+>\s+|void\s+|int\s+|String\s+|bool\s+|double\s+|dynamic\s+|(\w+)\s+)?(\w+)\s*\(([^)]*)\)\s*(?:async\s*)?\{", name=2, args=3, steps=((" ", -1),), skip=_NO),
    Rule(("dart",), "class", r"(?:abstract\s+)?(?:class|mixin)\s+(\w+)(?:\s+extends\s+(\w+))?", bases=(2,)),
    Rule(_EX, "function", r"def[p]?\s+(\w+)\s*\(([^)]*)\)", args=2, span=5),
    Rule(_EX, "class", r"defmodule\s+([\w.]+)"),
    Rule(_SH, "function", r"(?:function\s+)?(\w+)\s*\(\s*\)\s*\{", span=5),
    Rule(("lua",), "function", r"(?:local\s+)?function\s+([\w.:]+)\s*\(([^)]*)\)", args=2, span=5),
    Rule(("r",), "function", r"(\w+)\s*<-\s*function\s*\(([^)]*)\)", args=2, steps=(("=", 0),), span=5),
    Rule(("jl",), "function", r"function\s+(\w+)\s*\(([^)]*)\)", args=2, steps=(("::", 0),), span=5),
    Rule(("jl",), "class", r"(?:mutable\s+)?struct\s+(\w+)"),
    Rule(("zig",), "function", r"(?:pub\s+)?fn\s+(\w+)\s*\(([^)]*)\)", args=2, steps=((":", 0),), span=5),
    Rule(("zig",), "class", r"const\s+(\w+)\s*=\s*(?:packed\s+)?struct"),
    Rule(("nim",), "function", r"(?:proc|func|method)\s+(\w+)\s*\(([^)]*)\)", args=2, steps=((":", 0),), span=5),
    Rule(("nim",), "class", r"type\s+(\w+)\s*=\s*(?:object|ref object|enum)"),
)
#: The rules of languages without any of their own; fixed values.
_SKIP = ("if", "for", "while", "switch", "catch", "return", "else", "case", "try", "except", "finally", "with", "elif", "sizeof", "typeof", "instanceof", "new", "delete")
GENERAL = (
    Rule((), "function", r"(?:public|private|protected|static|inline|virtual|async|export)?\s*(?:\w+\s+)?(\w+)\s*\(([^)]*)\)\s*[{:]", args=2, steps=((" ", -1), (":", 0)), span=5, skip=_SKIP, once="text"),
    Rule((), "function", r"function\s+(\w+)\s*\(([^)]*)\)", args=2, steps=((" ", -1), (":", 0)), span=5, skip=_SKIP, once="text"),
    Rule((), "function", r"def\s+(\w+)\s*\(([^)]*)\)", args=2, steps=((" ", -1), (":", 0)), span=5, skip=_SKIP, once="text"),
    Rule((), "function", r"fn\s+(\w+)\s*\(([^)]*)\)", args=2, steps=((" ", -1), (":", 0)), span=5, skip=_SKIP, once="text"),
    Rule((), "function", r"(?:proc|func|method|sub)\s+(\w+)\s*\(([^)]*)\)", args=2, steps=((" ", -1), (":", 0)), span=5, skip=_SKIP, once="text"),
    Rule((), "class", r"(?:class|struct|interface|trait|protocol|enum|union|type)\s+(\w+)", once="text"),
    Rule((), "class", r"(?:module|namespace)\s+(\w+)", once="text"),
)
_OF = {lang: [(r, re.compile(r.pattern, r.flags)) for r in RULES if lang in r.languages] for lang in {x for r in RULES for x in r.languages}}
_OTHER = [(r, re.compile(r.pattern)) for r in GENERAL]


def _general_name(rule: Rule, name: str) -> bool:
    """Without rules of the language, names need two signs, functions must not be key words, and classes begin with a capital."""
    if len(name) < 2:
        return False
    return name.lower() not in rule.skip if rule.kind == "function" else not name[0].islower() or name == "main"


def rule_symbols_of(source: str, language: str) -> list[dict]:
    """The symbols that a language's rules find, rule by rule; lines follow from the places of the matches."""
    feeds = [m.start() for m in re.finditer("\n", source)]
    out: list[dict] = []
    lines: set[tuple[str, int]] = set()
    names: set[tuple[str, str]] = set()
    own = _OF.get(language)
    for rule, pattern in own or _OTHER:
        for m in pattern.finditer(source, 0, rule.head or len(source)):
            name, line = m[rule.name], bisect.bisect_left(feeds, m.start()) + 1
            if name in rule.skip or (own is None and not _general_name(rule, name)):
                continue
            if rule.once == "line" and (name, line) in lines or rule.once == "text" and (rule.kind, name) in names:
                continue
            names.add((rule.kind, name))
            if rule.kind == "function":
                lines.add((name, line))
            bases = [b.strip() for g in rule.bases if m[g] for b in m[g].split(",")]
            last = line if rule.kind == "import" else line + rule.span
            out.append(_symbol(rule.kind, name, line, last, owner=m[rule.owner] if rule.owner else None, is_method=rule.method, args=rule.arguments(m[rule.args]) if rule.args else [], returns=(m[rule.returns] or None) if rule.returns else None, bases=bases))
    return out


def symbols_of(path: str | None, source: str | None) -> list[dict]:
    """The symbols of a file, by the language that its path names."""
    language = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""
    if not source:
        return []
    return python_symbols_of(source) if language in ("py", "pyw", "pyi") else rule_symbols_of(source, language)


def source_symbols(files: DataFrame, path: str, text: str) -> DataFrame:
    """path and SYMBOL of every symbol of every file, in the order of the rules; `place` counts them within a file.

    A null text, or a Python file that cannot be parsed, has no symbols.
    """
    schema = StructType([StructField(path, StringType()), StructField("place", IntegerType()), *SYMBOL.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, places, found = [], [], []
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = symbols_of(p, x)
                found += own
                paths += [p] * len(own)
                places += range(len(own))
            columns = [pa.array(paths, pa.string()), pa.array(places, pa.int32())]
            columns += [_calls_column(found, f.type) if f.name == "calls" else pa.array([s.get(f.name) for s in found], f.type) for f in list(arrow)[2:]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return files.select(F.col(path).cast("string").alias(path), text).mapInArrow(run, schema)


def _calls_column(found: list[dict], kind: pa.ListType) -> pa.Array:
    """The calls of symbols; their receivers and names are made as two columns."""
    calls = [c for s in found for c in s["calls"]]
    ends = pa.array(itertools.accumulate((len(s["calls"]) for s in found), initial=0), pa.int32())
    parts = [pa.array([c[f.name] for c in calls], f.type) for f in kind.value_type]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)
