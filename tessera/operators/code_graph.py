"""The graph of a code base from the symbols of its files: nodes, edges, and what calls and base classes refer to.

Symbols come from `sources.symbols.source_symbols`.  Ids are `path` of files and
`path:name` of functions and classes, with the class before a method's name.

A name that many functions have is never joined with them all: functions are
first reduced to one row a name and folder or top package, with their number,
and every name that a folder's files call is joined with at most one row of each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prefixes
from .store import settled

#: Names that are taken to be external without an import.  Fixed values.
EXTERNAL = (
    "os", "sys", "re", "json", "time", "math", "pathlib", "pickle", "subprocess", "shutil", "shlex", "socket", "threading", "asyncio",
    "hashlib", "hmac", "base64", "urllib", "http", "email", "smtplib", "ftplib", "sqlite3", "csv", "xml", "html", "datetime", "collections",
    "itertools", "functools", "typing", "dataclasses", "enum", "abc", "logging", "tempfile", "io", "ctypes", "platform", "ast", "inspect",
    "traceback", "warnings", "atexit", "signal", "argparse", "random", "secrets", "string", "textwrap", "unicodedata", "struct", "array",
    "queue", "concurrent", "multiprocessing", "copy", "weakref", "contextlib", "glob", "fnmatch", "linecache", "fileinput",
    "requests", "httpx", "urllib3", "numpy", "pandas", "torch", "transformers", "chromadb", "z3", "llama_cpp", "pyperclip",
    "yaml", "toml", "click", "typer", "flask", "fastapi", "django", "pytest", "unittest",
)
#: Functions of one name beyond which a call from elsewhere is not guessed.
MOST = 5


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def top_package(path: Column) -> Column:
    """The first folder of a path, or the name of a file that stands in none, without a drive and without its ending."""
    plain = F.regexp_replace(F.translate(path, "\\", "/"), "^/*.:", "")
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.coalesce(F.regexp_replace(F.get(parts, F.lit(0)), r"\.[^.]*$", ""), F.lit("")))


def _id(path: str, name: Column) -> Column:
    return F.concat(F.col(path), F.lit(":"), name)


def _functions(symbols: DataFrame, path: str) -> DataFrame:
    """id, name, owner, path and place of every function; of several with one id, the first."""
    whole = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    f = symbols.where("kind = 'function'").select(_id(path, whole).alias("id"), "name", whole.alias("whole"), "owner", F.col(path).alias("path"), "place")
    return f.groupBy("id", "name", "whole", "owner", "path").agg(F.min("place").alias("place"))


def nodes(files: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """(id, kind, name, path) of files, functions and classes."""
    f = files.select(F.col(path).alias("id"), F.lit("file").alias("kind"), F.regexp_extract(path, "[^/]*$", 0).alias("name"), F.col(path).alias("path"))
    functions = _functions(symbols, path).select("id", F.lit("function").alias("kind"), F.col("whole").alias("name"), "path")
    classes = symbols.where("kind = 'class'").select(_id(path, F.col("name")).alias("id"), F.lit("class").alias("kind"), "name", F.col(path).alias("path"))
    return f.unionByName(functions).unionByName(classes).distinct()


def imported_names(symbols: DataFrame, path: str) -> DataFrame:
    """(path, name) of what a file's imports bring: modules and their parents, names and aliases."""
    none = F.array().cast("array<string>")
    alias = F.when(F.col("alias").isNotNull() & (~F.col("is_from") | (F.size("names") > 0)), F.array("alias")).otherwise(none)
    names = F.concat(prefixes(F.col("name")), F.array("name"), F.when(F.col("is_from"), F.col("names")).otherwise(none), alias)
    return symbols.where("kind = 'import'").select(F.col(path).alias("path"), F.explode(names).alias("name")).distinct()


def _calls(symbols: DataFrame, path: str, external: tuple[str, ...]) -> DataFrame:
    """(source, dir, top, receiver, name, here, sites) of the different calls of each function; here: what it means by its file alone, or null.

    What a file imports and defines is one row, and meets the file's functions before their calls are dealt out.
    """
    whole = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    f = symbols.where("kind = 'function'").select(F.col(path).alias("path"), _id(path, whole).alias("source"), "owner", "name", "place", "calls")
    names = f.where("name IS NOT NULL").repartition("path").groupBy("path", "name").agg(F.min(F.struct("place", "source"))["source"].alias("id"), F.collect_set(F.when(F.col("owner").isNotNull(), F.struct("owner", "name"))).alias("methods"))
    defined = names.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "id"))).alias("in_file"), F.flatten(F.collect_list("methods")).alias("methods"))
    imports = imported_names(symbols, path).groupBy("path").agg(F.collect_set("name").alias("imports"))
    none = F.array().cast("array<string>")
    files = defined.join(imports, "path", "left").select("path", folder(F.col("path")).alias("dir"), top_package(F.col("path")).alias("top"), "in_file", "methods", F.coalesce("imports", none).alias("imports"))

    def meant(c: Column) -> Column:
        receiver, name = c["receiver"], c["name"]
        own = receiver.isin("self", "cls")
        look = F.when(receiver == "", name).when(~own, F.substring_index(receiver, ".", 1))
        is_external = look.isNotNull() & (F.array_contains("imports", look) | look.isin(*external))
        outside = F.concat(F.lit("__external__:"), F.when(receiver != "", F.concat(receiver, F.lit("."))).otherwise(""), name)
        in_file = F.try_element_at("in_file", name)
        in_class = F.when(F.array_contains("methods", F.struct(F.col("owner").alias("owner"), name.alias("name"))), F.concat("path", F.lit(":"), "owner", F.lit("."), name))
        return F.when(is_external, outside).when(own, F.coalesce(in_class, in_file, F.concat(F.lit("__unresolved__:"), name))).otherwise(in_file)

    calls = F.transform("calls", lambda c: F.struct(c["receiver"].alias("receiver"), c["name"].alias("name"), meant(c).alias("here")))
    met = f.join(files.hint("merge"), "path").select("path", "source", "dir", "top", F.explode(calls).alias("c")).select("path", "source", "dir", "top", "c.*")
    return met.groupBy("path", "source", "dir", "top", "receiver", "name", "here").agg(F.count("*").alias("sites")).drop("path")


def resolved_calls(symbols: DataFrame, path: str, most: int = MOST, external: tuple[str, ...] = EXTERNAL) -> DataFrame:
    """(source, target, receiver, name, sites): the node that each call means, `__external__:...`, or `__unresolved__:name`.

    What is called on an imported or well-known name is external, and so is such
    a name itself.  `self` and `cls` mean the class, else the file.  All others
    mean the only function of the name, else the first of the file, else of the
    folder; else, of at most `most`, the only one of the top package, or the first
    if all are of the caller's.

    Most calls mean what their file says.  The others, written once, are asked
    for a name and folder at a time, not a call at a time.
    """
    calls, functions = settled(_calls(symbols, path, external)), _functions(symbols, path)
    functions = functions.withColumns({"dir": folder(F.col("path")), "top": top_package(F.col("path")), "first": F.struct("path", "place", "id")})
    in_dir = functions.groupBy("dir", "name").agg(F.min("first")["id"].alias("in_dir"))
    in_top = functions.groupBy("top", "name").agg(F.min("first").alias("top_first"), F.count("*").alias("top_n"))
    in_all = in_top.groupBy("name").agg(F.min("top_first")["id"].alias("first"), F.sum("top_n").alias("n"), F.count("*").alias("tops"))
    met = calls.where("here IS NULL").select("dir", "top", "name").distinct().join(in_dir, ["dir", "name"], "left")
    met = met.join(in_top.select("top", "name", F.col("top_first.id").alias("in_top"), "top_n"), ["top", "name"], "left").join(in_all, "name", "left")

    elsewhere = F.when(F.col("n") > most, None).when((F.col("top") != "") & ((F.col("tops") > 1) | F.col("top_n").isNull()), F.when(F.col("top_n") == 1, F.col("in_top"))).otherwise(F.col("first"))
    scoped = F.when(F.col("n") == 1, F.col("first")).otherwise(F.coalesce("in_dir", elsewhere))
    met = met.select("dir", "top", "name", scoped.alias("meant")).where("meant IS NOT NULL")
    asked = calls.where("here IS NULL").join(met, ["dir", "top", "name"], "left")
    asked = asked.select("source", F.coalesce("meant", F.concat(F.lit("__unresolved__:"), "name")).alias("target"), "receiver", "name", "sites")
    return calls.where("here IS NOT NULL").select("source", F.col("here").alias("target"), "receiver", "name", "sites").unionByName(asked)


def edges(symbols: DataFrame, path: str, most: int = MOST, external: tuple[str, ...] = EXTERNAL) -> DataFrame:
    """(source, kind, target, sites): defines, calls, inherits and imports, with what they mean.

    A base class means the last function of its name, by path and place, if there is one.
    """
    whole = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    defined = symbols.where("kind IN ('function', 'class')").select(F.col(path).alias("source"), _id(path, F.when(F.col("kind") == "class", F.col("name")).otherwise(whole)).alias("target"))
    imports = symbols.where("kind = 'import'").select(F.col(path).alias("source"), F.concat(F.lit("__import__:"), "name").alias("target"))
    bases = symbols.where("kind = 'class'").select(_id(path, F.col("name")).alias("source"), F.explode("bases").alias("base"))
    f = _functions(symbols, path)
    last = f.select(F.explode(F.array_distinct(F.array("name", "whole"))).alias("base"), F.struct("path", "place", "id").alias("at")).groupBy("base").agg(F.max("at")["id"].alias("id"))
    inherits = bases.join(last, "base", "left").select("source", F.coalesce("id", F.concat(F.lit("__unresolved__:"), "base")).alias("target"))

    def counted(rows: DataFrame, kind: str) -> DataFrame:
        return rows.groupBy("source", "target").agg(F.count("*").alias("sites")).select("source", F.lit(kind).alias("kind"), "target", "sites")

    calls = resolved_calls(symbols, path, most, external).groupBy("source", "target").agg(F.sum("sites").alias("sites")).select("source", F.lit("calls").alias("kind"), "target", "sites")
    return counted(defined, "defines").unionByName(calls).unionByName(counted(inherits, "inherits")).unionByName(counted(imports, "imports"))


#: Names that are called from outside, and decorators that register functions.  Fixed values.
ENTRIES = ("main", "__main__", "run", "serve", "handle", "setup", "teardown", "dispatch", "wsgi_app", "asgi_app")
REGISTERED = ("route", "get", "post", "put", "delete", "patch", "endpoint", "app.", "router.", "click.", "cli.", "fixture", "mark.", "app.task", "celery", "on_event", "on_message", "handler")
TESTS = r"(^|/)(tests?|examples?)(/|$)"


def dead_functions(files: DataFrame, symbols: DataFrame, path: str, text: str, most: int = MOST, private_too: bool = True, external: tuple[str, ...] = EXTERNAL) -> DataFrame:
    """(path, function, line, complexity, lines) of functions that nothing calls and no other file names.

    Left out are names between double underscores, entry points, tests and what a
    decorator registers; without `private_too`, names with one underscore.  A
    name's files are counted once for all functions that have it, before any are
    joined, so a name that stands in every file is one row a task: the function's
    own file is taken off the count, and what is left says whether another file
    has it.
    """
    whole = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    f = symbols.where("kind = 'function'").select(_id(path, whole).alias("id"), F.col(path).alias("path"), whole.alias("function"), F.element_at(F.split("name", r"\."), -1).alias("short"), "line", "last", "complexity", "decorators", "place")
    f = f.groupBy("id", "path", "function", "short").agg(F.min_by(F.struct("line", "last", "complexity", "decorators"), "place").alias("s")).select("id", "path", "function", "short", "s.*")
    registered = F.exists("decorators", lambda d: F.exists(F.array(*[F.lit(x) for x in REGISTERED]), lambda x: F.contains(d, x)))
    f = f.where(~(F.col("short").startswith("__") & F.col("short").endswith("__")) & ~F.col("short").isin(*ENTRIES) & ~registered & ~F.lower(F.translate("path", "\\", "/")).rlike(TESTS))
    if not private_too:
        f = f.where(~F.col("short").startswith("_") | F.col("short").startswith("__"))
    called = resolved_calls(symbols, path, most, external).select(F.col("target").alias("id")).distinct()
    f = settled(f.join(called, "id", "left_anti"))
    words = lambda text: F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0))
    counts = files.select(F.explode(F.array_distinct(words(text))).alias("short")).groupBy("short").agg(F.count("*").alias("_files"))
    own = files.select(F.col(path).alias("path"), F.col(text).alias("_text")).join(f.groupBy("path").agg(F.collect_set("short").alias("_shorts")).hint("merge"), "path")
    own = own.select("path", F.explode(F.array_intersect("_shorts", words("_text"))).alias("short"), F.lit(1).alias("_own"))
    met = f.join(own.hint("merge"), ["path", "short"], "left").join(counts.hint("merge"), "short", "left")
    alone = F.coalesce("_files", F.lit(0)) - F.coalesce("_own", F.lit(0)) == 0
    return met.where(alone).select("path", "function", "line", "complexity", F.greatest(F.lit(1), F.col("last") - F.col("line") + 1).alias("lines"))


def contexts(symbols: DataFrame, path: str, most: int = 8, hops: int = MOST) -> DataFrame:
    """(id, path, callers, callees) of every function: the first `most` functions that call it and that it calls, by id.

    Ranks are taken before lists are made, so a function that everything calls has a short list too.
    """
    functions = _functions(symbols, path).select("id", "path")
    edges = settled(resolved_calls(symbols, path, hops).select("source", "target").distinct().where("source <> target").join(functions.select(F.col("id").alias("target")), "target", "left_semi"))

    def first(own: str, other: str, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(own).orderBy(other))
        return edges.withColumn("n", rank).where(F.col("n") <= most).groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_list(other)).alias(name))

    none = F.array().cast("array<string>")
    met = functions.join(first("target", "source", "callers"), "id", "left").join(first("source", "target", "callees"), "id", "left")
    return met.select("id", "path", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


#: Scores of what a question's names mean: the function, a name within it, the class, its methods, the file, and neighbours.  Fixed values.
SCORES = (1.0, 0.9, 0.85, 0.75, 0.65, 0.5)


def retrieved(files: DataFrame, symbols: DataFrame, path: str, entities: list[str], hops: int = MOST) -> DataFrame:
    """(id, kind, name, path, score) of the nodes that names in a question lead to, each with its best score.

    A function counts if its name is an entity, ends with one behind a dot or
    begins with one; a class or a file if its name holds one.  Then come names
    that stand behind a dot in a function's name, methods of a class, what is in
    a file, and what calls a function or is called by it.  Entities are few, in
    lower case; all else is joined by names, one row each.
    """
    asked = F.array(*[F.lit(e) for e in entities]).cast("array<string>")
    any_of = lambda test: F.exists(asked, test)
    all_ = settled(nodes(files, symbols, path))
    low = F.lower("name")
    direct = all_.where((F.col("kind") == "function") & any_of(lambda e: (low == e) | F.endswith(low, F.concat(F.lit("."), e)) | F.startswith(low, e))).select("id", "name")
    classes = all_.where((F.col("kind") == "class") & any_of(lambda e: F.contains(low, e))).select("name").distinct()
    stem = F.lower(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", ""))
    in_files = all_.where((F.col("kind") == "file") & any_of(lambda e: F.contains(stem, e))).select("path").distinct()
    short = F.element_at(F.split("name", r"\."), -1)
    parts = direct.where(F.contains("name", F.lit("."))).select(short.alias("part")).distinct()
    parts = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda i: F.substring(F.col("part"), F.lit(1), i))).alias("name")).distinct()

    calls = resolved_calls(symbols, path, hops).select("source", "target").distinct()
    named = all_.where("kind = 'function'").select("id", "name")
    calls = calls.join(named.select(F.col("id").alias("target"), F.col("name").alias("callee")), "target").join(named.select(F.col("id").alias("source"), F.col("name").alias("caller")), "source").select("caller", "callee")
    calls = settled(calls.distinct())
    names = direct.select("name").distinct()
    shorts = names.select("name").union(names.select(short)).distinct()
    callee_short = F.element_at(F.split("callee", r"\."), -1)
    callers = calls.join(shorts.select(F.col("name").alias("callee")), "callee", "left_semi").select("caller").union(calls.where(callee_short != F.col("callee")).withColumn("s", callee_short).join(shorts.select(F.col("name").alias("s")), "s", "left_semi").select("caller"))
    callees = calls.join(names.select(F.col("name").alias("caller")), "caller", "left_semi").select("callee")
    near = callers.union(callees).toDF("name").distinct()

    def scored(df: DataFrame, score: float) -> DataFrame:
        return df.select("id", "kind", "name", "path", F.lit(score).alias("score"))

    exact, within, of_class, method, of_file, neighbour = SCORES
    owner = F.substring_index("name", ".", 1)
    found = [
        scored(all_.join(names, "name", "left_semi"), exact), scored(all_.join(parts, "name", "left_semi"), within), scored(all_.join(classes, "name", "left_semi"), of_class),
        scored(all_.where(F.contains("name", F.lit("."))).withColumn("_o", owner).join(classes.select(F.col("name").alias("_o")), "_o", "left_semi"), method),
        scored(all_.join(in_files, "path", "left_semi"), of_file), scored(all_.join(near, "name", "left_semi"), neighbour),
    ]
    return reduce(DataFrame.unionByName, found).groupBy("id", "kind", "name", "path").agg(F.max("score").alias("score"))
