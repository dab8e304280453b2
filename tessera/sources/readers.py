"""Readers: JSON files, JSON lines, source trees, diffs, git logs, source files and generated pairs."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SKIPPED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build")
EXTENSIONS = ("py", "js", "ts", "go", "rs", "java", "c", "cpp", "h", "rb", "php", "swift", "sql", "sh", "md")


def json_files(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """One object a file; files that cannot be parsed are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ignore_patterns(spark: SparkSession, root: str) -> list[str]:
    """The plain patterns of a tree's ignore file: no comments, no negations; `*.x` is the suffix `.x`.  Without a file, none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/.gitignore")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    stream = fs.open(at)  # Spark's readers skip hidden files
    try:
        lines = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
    return [x for x in (ignore_pattern(line) for line in lines) if x]


def ignore_pattern(line: str) -> str | None:
    line = line.strip()
    if not line or line[0] in "#!":
        return None
    line = line.strip("/")
    return line[1:] if line.startswith("*.") else line or None


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path holds a pattern, or ends with one that is a suffix."""
    out = F.lit(False)
    for p in patterns:
        out = out | (path.endswith(p) if p.startswith(".") else F.contains(path, F.lit(p)))
    return out


def source_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, most: int = 2 << 20, ignore: list[str] | None = None) -> DataFrame:
    """(path, length, text) of a tree's source files, without large ones, skipped folders and what `ignore` (see `ignore_patterns`) names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*extensions) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in SKIPPED])) & ~ignored(F.col("path"), ignore or [])
    return files.where((F.col("length") <= most) & wanted).select("path", "length", F.decode("content", "UTF-8").alias("text")).orderBy("path")


def git_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines `commit|author|epoch|date|subject|files`, six parts at most, as columns."""
    p = F.split(column, r"\|", 6)
    names = ("commit", "author", "ts", "date", "message", "files")
    return lines.select(*(F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names))).withColumn("ts", F.col("ts").try_cast("long"))


def git_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """Porcelain status lines as (path, state): untracked, staged, modified or both."""
    x, y = F.substring(column, 1, 1), F.substring(column, 2, 1)
    state = F.when(x == "?", "untracked").when((x != " ") & (y != " "), "both").when(x != " ", "staged").otherwise("modified")
    return lines.select(F.expr(f"substring({column}, 4)").alias("path"), state.alias("state"))


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str | None) -> list[tuple[str, int, int, int, int, int, int]]:
    """(file, old_start, old_count, new_start, new_count, added, removed) of each hunk of a unified diff."""
    out: list[list] = []
    file, old, new = "", 0, 0  # lines that the hunk still has on either side
    for line in (text or "").split("\n"):
        if old > 0 or new > 0:
            sign = line[:1]
            out[-1][5] += sign == "+"
            out[-1][6] += sign == "-"
            old -= sign not in ("+", "\\")
            new -= sign not in ("-", "\\")
        elif line.startswith("+++ "):
            file = re.sub(r"^b/", "", line[4:].rstrip("\r").split("\t")[0])
        elif m := _HUNK.match(line):
            old, new = int(m[2] or 1), int(m[4] or 1)
            out.append([file, int(m[1]), old, int(m[3]), new, 0, 0])
    return [tuple(x) for x in out]


HUNKS = "array<struct<file:string,old_start:int,old_count:int,new_start:int,new_count:int,added:int,removed:int>>"


def diff_hunks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A row a hunk of each diff."""
    return rows_of(rows, key, text, parse_diff, HUNKS)


def rows_of(rows: DataFrame, key: str, text: str, parse: Callable[[str | None], list[tuple]], kind: str) -> DataFrame:
    """The key with a row for each tuple that `parse` finds in the text, over Arrow batches."""
    one = rows.select(key, F.lit(None).cast(kind).alias("h")).select(key, F.inline("h")).schema
    arrow = to_arrow_schema(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x) for x in batch.column(1).to_pylist()]
            owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [r for f in found for r in f]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *(pa.array([r[k] for r in flat], arrow.field(k + 1).type) for k in range(len(arrow) - 1))], names=arrow.names)

    return rows.select(key, text).mapInArrow(run, one)


_BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension, ast.IfExp)


def complexity(node: ast.AST) -> int:
    """One more than the branches of a function; further operands of and/or count each."""
    return 1 + sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))


def function_range(source: str | None, name: str) -> tuple[int, int] | None:
    """(first, last) line of a function by its qualified name, such as `f`, `A.f` or `A.B.f`."""
    try:
        scope: list[tuple[ast.AST, str]] = [(ast.parse(source or ""), "")]
    except (SyntaxError, ValueError):
        return None
    while scope:
        node, at = scope.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                full = f"{at}.{child.name}" if at else child.name
                if full == name and not isinstance(child, ast.ClassDef):
                    return child.lineno, child.end_lineno or child.lineno
                scope.append((child, full))
    return None


def function_ranges(files: DataFrame, path: str, text: str, name: str) -> DataFrame:
    """path, name, first and last line of the function that each row names; rows without it are left out."""
    names = [path, text, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, wanted = (batch.column(i).to_pylist() for i in range(3))
            found = [(p, n, r) for p, x, n in zip(paths, texts, wanted, strict=True) if n and (r := function_range(x, n))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), *(pa.array([f[2][k] for f in found], pa.int32()) for k in (0, 1))], names=["path", "name", "first", "last"])

    return files.select(F.col(names[0]).cast("string"), names[1], names[2]).mapInArrow(run, "path string, name string, first int, last int")


#: Domains of generated problems.
DOMAINS = ("add", "subtract", "multiply", "percentage", "rectangle", "circle", "triangle", "prime")


def generated_pairs(rows: DataFrame, key: str, domain: str, a: Column, b: Column) -> DataFrame:
    """key, id, domain, problem, solution and difficulty: a problem with its worked solution for each row's domain and numbers, all of it checkable again."""
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    signs = {"add": ("+", a + b), "subtract": ("-", a - b), "multiply": ("*", a * b)}
    problem, solution = F.lit(None).cast("string"), F.lit(None).cast("string")
    whole = {}
    for name, (sign, value) in signs.items():
        whole[name] = (said("What is ", a, f" {sign} ", b, "?"), said("The answer is ", value, ".\n\nStep by step:\n", a, f" {sign} ", b, " = ", value))
    share, disc = b * a / F.lit(100.0), F.round(F.lit(3.141592653589793) * a * a, 4)
    whole["percentage"] = (said("What is ", a, "% of ", b, "?"), said("The answer is ", share, ".\n\n", a, "% of ", b, " = (", a, "/100) × ", b, " = ", share))
    whole["rectangle"] = (said("What is the area of a rectangle with width ", a, " and height ", b, "?"), said("Area = width × height = ", a, " × ", b, " = ", a * b, " square units."))
    whole["circle"] = (said("What is the area of a circle with radius ", a, "?"), said("Area = π × r² = π × ", a, "² = π × ", a * a, " ≈ ", disc, " square units."))
    whole["triangle"] = (said("What is the area of a triangle with base ", a, " and height ", b, "?"), said("Area = (base × height) / 2 = (", a, " × ", b, ") / 2 = ", a * b, " / 2 = ", a * b / F.lit(2.0), " square units."))
    prime = (a >= 2) & ~F.exists(F.when(a >= 4, F.sequence(F.lit(2), F.floor(F.sqrt(a)).cast("int"))).otherwise(F.array().cast("array<int>")), lambda d: a % d == 0)
    whole["prime"] = (said("Is ", a, " a prime number?"), said(a, F.when(prime, " is prime.").otherwise(" is not prime.")))
    hard = F.when(F.col(domain).isin(*signs), F.least(F.lit(1.0), F.greatest(a, b) / F.lit(1000.0))).when(F.col(domain) == "percentage", 0.3).otherwise(0.4)
    for name, (p, q) in whole.items():
        problem, solution = F.when(F.col(domain) == name, p).otherwise(problem), F.when(F.col(domain) == name, q).otherwise(solution)
    out = rows.select(key, domain, problem.alias("problem"), solution.alias("solution"), hard.alias("difficulty")).where("problem IS NOT NULL")
    return out.withColumn("id", F.substring(F.md5(F.col("problem").cast("binary")), 1, 12))


#: Values that break functions, with what is odd about them, by kind of parameter.  Fixed values.
EDGES = {
    "numeric": (("0", "boundary"), ("-1", "negative"), ("1", "boundary"), ("-999999", "overflow"), ("999999", "overflow"), ("0.0", "float"), ("-0.0", "negative_zero"), ("float('inf')", "infinity"), ("float('-inf')", "negative_infinity"), ("float('nan')", "nan"), ("0.1 + 0.2", "float_precision")),
    "string": (('""', "empty"), ('" "', "whitespace"), ('"a"', "single_char"), ('"a" * 10000', "very_long"), ("None", "null"), ('"\\n\\t\\r"', "special_chars"), ('"hello\\x00world"', "null_byte"), ('"<script>alert(1)</script>"', "xss"), ('"DROP TABLE users;--"', "sql_injection"), ('"é"', "unicode")),
    "list": (("[]", "empty"), ("[1]", "single"), ("[1, 2, 3]", "normal"), ("list(range(10000))", "very_large"), ("None", "null"), ("[None]", "contains_null"), ("[1, None, 3]", "mixed_null"), ("[1, 'a', 2.0]", "mixed_types"), ("[[1, 2], [3, 4]]", "nested"), ("[1, 1, 1, 1]", "all_same"), ("[5, 4, 3, 2, 1]", "reverse_sorted"), ("[float('nan'), 1, 2]", "contains_nan")),
    "dict": (("{}", "empty"), ("None", "null"), ('{"a": 1}', "single"), ('{"a": None}', "null_value"), ('{1: "a", 2: "b"}', "int_keys")),
}


def edge_calls(functions: DataFrame, name: str, kind: str) -> DataFrame:
    """name, kind, value, category and call: a call of each function with every value that may break a parameter of its kind; unknown kinds count as numeric."""
    cases = {k: F.array(*[F.struct(F.lit(v).alias("value"), F.lit(c).alias("category")) for v, c in rows]) for k, rows in EDGES.items()}
    of = cases["numeric"]
    for k, rows in cases.items():
        of = F.when(F.col(kind) == k, rows).otherwise(of)
    out = functions.select(name, kind, F.explode(of).alias("c")).select(name, kind, "c.*")
    return out.withColumn("call", F.concat(F.col(name), F.lit("("), "value", F.lit(")")))


def batches(rows: Iterator, size: int = 100) -> Iterator[list]:
    """Lists of at most `size` rows."""
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
