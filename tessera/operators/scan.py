"""Pattern scans over source text: rule tables, findings with places, blanked literals, stages and chains."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import rows_of
from .store import settled

#: Where untrusted data enters.  Fixed values.
SOURCES = {
    "http_input": (r"\brequest\.(?:args|form|json|values|data|files|cookies|headers|body|params|query_params|path_params)\b", r"\brequest\.(?:GET|POST|FILES|META|COOKIES)\b", r"\bawait\s+request\.(?:json|form|body)\(\)", r"\bbody\s*[:=]\s*await", r"\.get_json\s*\(", r"\bself\.get_(?:query_|body_)?argument\s*\("),
    "cli_arg": (r"\bargparse\b", r"\bsys\.argv\b", r"(?<![\w.])input\s*\("),
    "env_var": (r"\bos\.environ\[", r"\bos\.getenv\s*\("),
    "file_read": (r"\.read\s*\(", r"(?<![\w.])open\s*\("),
    "deserialization_input": (r"\bpickle\.loads?\s*\(", r"\byaml\.load\s*\(", r"\bjson\.loads?\s*\("),
}
#: Dangerous operations by class.  Fixed values.
SINKS = {
    "sql_injection": (r"\.execute\s*\(\s*[fF][\"']", r"\.execute\s*\(\s*[\"'][^\"']*[\"']\s*[%+]", r"\.executemany\s*\(\s*[fF][\"']", r"\.raw\s*\(\s*[fF][\"']"),
    "command_injection": (r"\bos\.system\s*\(", r"\bsubprocess\.(?:call|run|Popen|check_output|check_call)\s*\([^)]*shell\s*=\s*True", r"(?<![\w.])eval\s*\(", r"(?<![\w.])exec\s*\(", r"\bcommands\.(?:getoutput|getstatusoutput)\s*\("),
    "path_traversal": (r"open\s*\(\s*[^)]*\+\s*[^)]*\)", r"open\s*\(\s*[fF][\"']", r"os\.path\.join\s*\([^)]*request\.", r"os\.path\.join\s*\([^)]*\bargv\b", r"Path\s*\([^)]*\+\s*[^)]*\)"),
    "unsafe_deserialization": (r"\bpickle\.loads?\s*\(", r"\byaml\.load\s*\(\s*[^,)]+\s*\)(?!\s*,\s*Loader)", r"\bshelve\.open\s*\(", r"\bmarshal\.loads?\s*\("),
    "xss": (r"render_template_string\s*\([^)]*\+", r"\bMarkup\s*\([^)]*\+", r"\.innerHTML\s*="),
    "ssrf": (r"requests\.(?:get|post|put|delete|patch|head)\s*\([^)]*\+", r"urllib\.request\.urlopen\s*\([^)]*\+", r"httpx\.\w+\s*\([^)]*\+"),
    "open_redirect": (r"redirect\s*\([^)]*request\.",),
    "weak_crypto": (r"\bhashlib\.md5\b", r"\bhashlib\.sha1\b", r"\bDES\.new\b", r"\bRC4\.new\b", r"(?<![\w.])random\.(?:random|randint|choice)\s*\([^)]*\)\s*#?\s*(?:token|secret|key|password|salt|nonce|iv)"),
    "hardcoded_secret": (r"(?i)(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?token|client[_-]?secret)\s*=\s*[\"'][a-zA-Z0-9_\-+/=]{12,}[\"']", r"AKIA[0-9A-Z]{16}", r"sk-[a-zA-Z0-9_\-]{20,}", r"ghp_[a-zA-Z0-9]{36}", r"xox[baprs]-[0-9a-zA-Z\-]{10,}", r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----"),
    "race_condition": (r"os\.path\.exists\([^)]+\)[^\n]*\n[^\n]*open\s*\(", r"os\.access\([^)]+\)[^\n]*\n[^\n]*open\s*\("),
    "insecure_temp": (r"\btempfile\.mktemp\s*\(",),
}
SEVERITY = {"sql_injection": "CRITICAL", "command_injection": "CRITICAL", "unsafe_deserialization": "CRITICAL", "path_traversal": "HIGH", "ssrf": "HIGH", "xss": "HIGH", "hardcoded_secret": "HIGH", "open_redirect": "MEDIUM", "weak_crypto": "MEDIUM", "race_condition": "MEDIUM", "insecure_temp": "LOW", "missing_auth": "HIGH"}
CWE = {"sql_injection": "CWE-89", "command_injection": "CWE-78", "unsafe_deserialization": "CWE-502", "path_traversal": "CWE-22", "ssrf": "CWE-918", "xss": "CWE-79", "hardcoded_secret": "CWE-798", "open_redirect": "CWE-601", "weak_crypto": "CWE-327", "race_condition": "CWE-362", "insecure_temp": "CWE-377", "missing_auth": "CWE-306"}
STAGE_WEIGHT = {"rce": 10, "destroy": 9, "persistence": 8, "secret_read": 7, "privesc": 6, "exfil": 5, "lateral": 0, "entry": 0}


def lookup(table: dict[str, object], column: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), column)


def classes(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The classes any of whose patterns matches, in the table's order."""
    return F.filter(F.array(*[F.when(F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)), name) for name, patterns in rules.items()]), lambda x: x.isNotNull())


#: A comment, or a literal up to its end: three quotes, or one quote on a line; a backslash takes the next sign with it.
_QUOTED = re.compile(r"#[^\n]*|\"{3}[\s\S]*?(?:(\"{3})|\Z)|'{3}[\s\S]*?(?:('{3})|\Z)|\"(?:\\[\s\S]|[^\"\n])*+(?:(\")|\n|\Z)|'(?:\\[\s\S]|[^'\n])*+(?:(')|\n|\Z)")
_SEEN = re.compile(r"[^\n]")


def blank_literals(source: str) -> str:
    """Source with the insides of strings and comments turned to blanks; lengths, line ends and quotes stay.

    The signs alone decide, so broken sources are blanked too, and so are the
    insides of formatted strings.  A line ends at a line feed, nowhere else.
    """

    def blank(m: re.Match) -> str:
        said = m[0]
        if said[0] == "#":
            return " " * len(said)
        quote = said[:3] if said[:3] in ("\"\"\"", "'''") else said[0]
        end = m[m.lastindex] if m.lastindex else ""
        return quote + _SEEN.sub(" ", said[len(quote) : len(said) - len(end)]) + end

    return _QUOTED.sub(blank, source)


class Lines:
    """The lines of a text, and the line (from 0) of a place in it; a line ends at a line feed, nowhere else."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def of(self, place: int) -> int:
        return bisect.bisect_left(self.ends, place)

    def __getitem__(self, n: int) -> str:
        begin = self.ends[n - 1] + 1 if n else 0
        return self.text[begin : self.ends[n] if n < len(self.ends) else len(self.text)]


def blanked(files: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, name): each text without what its literals and comments say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else blank_literals(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, name])

    return files.select(key, text).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, `{name}` string")


def _find(source: str | None) -> list[tuple[str, int, str]]:
    if not source:
        return []
    clean, lines = blank_literals(source), Lines(source)
    out = []
    for name, patterns in SINKS.items():
        where = source if name == "hardcoded_secret" else clean
        for p in patterns:
            for m in re.finditer(p, where):
                n = lines.of(m.start())
                text = lines[n].strip()
                if not text.startswith(("#", "//", "/*", "*")):
                    out.append((name, n + 1, text[:140]))
    return sorted(set(out), key=lambda f: (f[1], f[0]))


def findings(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, class, line, snippet, severity, cwe, confidence, fingerprint) of every match.

    Only files that some pattern can match reach the Python function.
    """
    maybe = F.size(classes(F.col(text), SINKS)) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, *f) for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in _find(x)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=[path, "class", "line", "snippet"])

    rows = files.where(maybe).select(F.col(path).cast("string").alias(path), text).mapInArrow(run, f"`{path}` string, class string, line int, snippet string")
    mark = F.substring(F.md5(F.concat_ws("|", path, "class", F.trim("snippet")).cast("binary")), 1, 10)
    return rows.withColumns({"severity": lookup(SEVERITY, F.col("class")), "cwe": lookup(CWE, F.col("class")), "confidence": F.when(F.col("class") == "hardcoded_secret", 0.8).otherwise(0.7), "fingerprint": mark})


#: Marks of a restricted call, of names that hash without a secret, of routes and of what guards them.  Fixed values.
SANDBOXES = (
    (r"__builtins__\s*[\":]\s*\{\s*\}", "empty __builtins__"),
    (r"__builtins__\s*[\":]\s*None", "None __builtins__"),
    (r"\bsafe_globals\b", "safe_globals"),
    (r"\brestricted_globals\b", "restricted_globals"),
    (r",\s*\{[^}]*\"__builtins__\"", "restricted globals dict"),
)
PLAIN_HASHES = ("_hash", "make_id", "_make_id", "_id", "cache", "fingerprint", "content_hash", "generate_id", "_generate_id", "dedupe", "dedup", "_make_pair", "_keyword_hash", "store")
ROUTES = ("route", ".get", ".post", ".put", ".delete", ".patch")
GUARDS = ("auth", "login_required", "requires_auth", "permission", "token_required", "jwt_required")
#: Folders whose secrets and hashes are of no interest.
TESTS = r"(^|/)(tests?|examples?)(/|$)"
#: Characters in which a call's bracket has to open, and its arguments to end.
OPENS, ENDS = 80, 600
_SANDBOXES = [(re.compile(p), name) for p, name in SANDBOXES]
_COMPILED = [(name, re.compile(p)) for name, patterns in SINKS.items() for p in patterns]
_BRACKETS = re.compile(r"[()]|\"(?:\\[\s\S]|[^\"\\])*+(?:\"|\Z)|'(?:\\[\s\S]|[^'\\])*+(?:'|\Z)")


def call_arguments(source: str, place: int) -> str:
    """The arguments of the call that begins at a place, up to the bracket that closes it; brackets in literals do not count."""
    opening = source.find("(", place, min(len(source), place + OPENS))
    if opening < 0:
        return ""
    end, depth = min(len(source), place + ENDS), 0
    for m in _BRACKETS.finditer(source, opening, end):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0:
            return source[opening + 1 : m.start()]
    return source[opening + 1 : end]


def _match(name: str, m: re.Match, source: str) -> tuple[str | None, str | None]:
    """What is called, where that matters (eval, exec, md5, sha1), and what makes it harmless."""
    said = re.search(r"eval|exec", m[0]) if name == "command_injection" else re.search(r"md5|sha1", m[0]) if name == "weak_crypto" else None
    if said is None or m[0].startswith(("os.", "subprocess", "commands")):
        return None, None
    args = call_arguments(source, m.start())
    if name == "weak_crypto":
        return said[0], "usedforsecurity=False" if re.search(r"usedforsecurity\s*=\s*False", args) else None
    return said[0], next((label for p, label in _SANDBOXES if p.search(args)), None)


_MATCHES = "class string, what string, mitigated string, line int, snippet string, whole boolean"


def matches(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, class, what, mitigated, line, snippet, whole) of every match; whole: in the text as it stands, literals included, which is how secrets are sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for p, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                clean, lines = blank_literals(source), Lines(source)
                for name, pattern in _COMPILED:
                    for whole, where in ((False, clean), (True, source)) if name == "hardcoded_secret" else ((False, clean),):
                        for m in pattern.finditer(where):
                            n = lines.of(m.start())
                            found.append((p, name, *_match(name, m, source), n + 1, lines[n].strip()[:140], whole))
            names = [path, *(c.split()[0] for c in _MATCHES.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()))], names=names)

    maybe = F.size(classes(F.col(text), SINKS)) > 0
    return files.where(maybe).select(F.col(path).cast("string").alias(path), text).mapInArrow(run, f"`{path}` string, {_MATCHES}")


def graded(files: DataFrame, path: str, text: str, symbols: DataFrame) -> DataFrame:
    """(path, function, class, line, severity, confidence, mitigated, snippet): findings in the light of where they stand.

    symbols: `sources.symbols.source_symbols` of the same files.  A match counts
    for every function around it, by a join of lines with ranges: run in a
    sandbox, or hashing for a name that needs no secret, it is low; hashing that
    says it is no security is none.  Secrets and weak hashes also count for the
    file (`<module>`), but for comments and tests.  A route without a guard among
    its decorators lacks authentication.  Matches are written once, and merged
    with the functions: Spark would judge what Python finds by the files' size.
    """
    found = settled(matches(files, path, text))
    whole = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    functions = symbols.where("kind = 'function'").select(F.col(path).alias("_path"), whole.alias("function"), F.col("line").alias("_first"), F.col("last").alias("_last"), "decorators")
    inside = found.where("NOT whole").join(functions.hint("merge"), (F.col(path) == F.col("_path")) & F.col("line").between(F.col("_first"), F.col("_last")))
    inside = inside.where((F.coalesce(F.col("what"), F.lit("")) != "md5") | F.col("mitigated").isNull())
    plain = F.col("what").isin("md5", "sha1") & F.exists(F.array(*[F.lit(x) for x in PLAIN_HASHES]), lambda x: F.contains(F.lower("function"), x))
    low = (F.col("what").isin("eval", "exec") & F.col("mitigated").isNotNull()) | F.coalesce(plain, F.lit(False))
    of_functions = inside.select(path, "function", "class", "line", F.when(low, "LOW").otherwise(lookup(SEVERITY, F.col("class"))).alias("severity"), F.when(low, 0.4).otherwise(0.6).alias("confidence"), F.when(F.col("what").isin("eval", "exec"), F.col("mitigated")).alias("mitigated"), "snippet")

    of_file = found.where(((F.col("class") == "hardcoded_secret") & F.col("whole")) | ((F.col("class") == "weak_crypto") & F.col("mitigated").isNull()))
    of_file = of_file.where(~F.lower(F.translate(path, "\\", "/")).rlike(TESTS) & ~F.col("snippet").rlike(r"^(#|//|/\*|\*)"))
    of_file = of_file.select(path, F.lit("<module>").alias("function"), "class", "line", lookup(SEVERITY, F.col("class")).alias("severity"), F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("mitigated"), "snippet")

    has = lambda marks: F.exists("decorators", lambda d: F.exists(F.array(*[F.lit(x) for x in marks]), lambda x: F.contains(F.lower(d), x)))
    routes = functions.where(has(ROUTES) & ~has(GUARDS)).select(F.col("_path").alias(path), "function", F.lit("missing_auth").alias("class"), F.col("_first").alias("line"), F.lit(SEVERITY["missing_auth"]).alias("severity"), F.lit(0.6).alias("confidence"), F.lit(None).cast("string").alias("mitigated"), F.lit(None).cast("string").alias("snippet"))
    return of_functions.unionByName(of_file).unionByName(routes)


def syntax_error(code: str | None) -> str:
    """What keeps Python code from being compiled; empty if nothing does.  Nothing is run."""
    if not code or not code.strip():
        return "empty code"
    try:
        compile(code, "<code>", "exec", dont_inherit=True)
    except SyntaxError as error:
        return f"SyntaxError: {error.msg} (line {error.lineno})"
    except (ValueError, RecursionError, MemoryError, OverflowError) as error:
        return f"{type(error).__name__}: {error}"
    return ""


def checked(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, sound and error of Python code."""
    return rows_of(files, key, text, lambda x: [((e := syntax_error(x)) == "", e)], "array<struct<sound:boolean,error:string>>")


def sarif(rows: DataFrame, path: str) -> DataFrame:
    """A SARIF-shaped document of rules and results for each path, so that no task holds all findings."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    result = F.struct(F.col("class").alias("ruleId"), level.alias("level"), F.struct(F.col(path).alias("uri"), F.col("line").alias("startLine")).alias("location"))
    return rows.groupBy(path).agg(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array_sort(F.collect_set(F.struct(F.col("class").alias("id"), F.col("cwe").alias("cwe")))).alias("rules"), F.array_sort(F.collect_list(result)).alias("results"))).alias("sarif"))


def chain_confidence(hops: Column, entry: Column, bonus: Column) -> Column:
    """How sure a chain is: less with each hop, more with its entry's confidence."""
    base = F.greatest(F.lit(0.25), 0.75 - 0.15 * hops) * (0.7 + 0.3 * entry) + bonus
    return F.greatest(F.lit(0.2), F.least(F.lit(0.98), base))
