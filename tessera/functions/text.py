"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in a query.  Fixed values.
FILLER = (
    "how", "does", "do", "is", "was", "are", "were", "the", "a", "an", "of", "in", "to", "for", "with", "on", "at", "by", "from", "what", "where", "when", "which", "who", "why", "this", "that", "these", "those",
    "can", "could", "would", "should", "may", "might", "my", "your", "our", "their", "me", "you", "us", "them", "and", "or", "but", "not", "also", "as", "if", "so", "than", "i", "we", "he", "she", "it", "they",
    "be", "been", "being", "have", "has", "had", "will", "shall", "get", "got", "show", "find", "list", "use", "used", "using", "there", "here", "then", "now", "just", "only", "really", "please", "help", "tell", "explain", "give", "make",
)
#: Words that do not count towards a keyword hash.  Fixed values.
STOP = (
    "a", "an", "the", "is", "are", "was", "were", "do", "does", "what", "how", "why", "when", "where", "who", "in", "on", "at", "to", "for", "of", "with", "and", "or", "but", "not", "can", "could", "would", "should", "will", "shall", "may",
    "i", "me", "my", "you", "your", "it", "its", "this", "that",
)
#: Topics by their keywords.  Fixed values.
TOPICS = {
    "code": ("code", "function", "class", "implement", "write", "debug"), "test": ("test", "pytest", "assert", "verify"), "deploy": ("deploy", "docker", "kubernetes", "ci/cd", "pipeline"), "database": ("database", "sql", "query", "migration", "schema"),
    "api": ("api", "endpoint", "rest", "http", "route"), "frontend": ("react", "html", "css", "component", "ui"), "config": ("config", "environment", "settings", "setup"),
}


def literal(words: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words(text: Column, lower: bool = True) -> Column:
    """Runs without white space; an empty text has none."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.lower(t) if lower else t, r"\s+"), lambda w: w != "")


def contains_any(text: Column, keys: tuple[str, ...] | list[str]) -> Column:
    return F.exists(literal(keys), lambda k: F.contains(text, k))


def hits(text: Column, keys: tuple[str, ...] | list[str]) -> Column:
    """How many of the keys the text holds."""
    return F.size(F.filter(literal(keys), lambda k: F.contains(text, k)))


def identifier_tokens(text: Column) -> Column:
    """Identifiers in lower case, with their snake_case and CamelCase parts."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    parts = F.flatten(F.transform(found, lambda w: F.concat(F.array(w), F.when(F.contains(w, F.lit("_")), F.split(w, "_+")).otherwise(F.array().cast("array<string>")), F.when(w.rlike("[a-z][A-Z]|[A-Z]{2}[a-z]"), F.split(w, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_+")).otherwise(F.array().cast("array<string>")))))
    return F.filter(F.transform(parts, F.lower), lambda w: w != "")


def query_terms(text: Column) -> Column:
    """Content words of a query, each once, in order."""
    return F.array_distinct(F.filter(F.array_except(words(text), literal(FILLER)), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def norm_hash(text: Column) -> Column:
    return F.md5(F.array_join(words(text), " ").cast("binary"))


def keyword_hash(text: Column) -> Column:
    kept = F.filter(F.array_except(words(text), literal(STOP)), lambda w: F.length(w) > 2)
    return F.md5(F.array_join(F.array_sort(F.array_distinct(kept)), " ").cast("binary"))


def topics(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(contains_any(t, keys), name) for name, keys in TOPICS.items()]), lambda x: x.isNotNull())


def mentioned_files(text: Column, most: int = 10) -> Column:
    """Names with a known extension, each once."""
    found = F.regexp_extract_all(text, F.lit(r"\b([\w/]+\.\w{1,5})\b"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda f: f.rlike(r"(?i)\.(py|js|ts|go|rs|java|yaml|json|toml|md)$"))), 1, most)


def core_answer(text: Column) -> Column:
    """The first sentence, by a stop or an exclamation mark, else the first hundred characters."""
    t = F.trim(text)
    return F.when(F.contains(t, F.lit(". ")), F.substring_index(t, ". ", 1)).when(F.contains(t, F.lit("!")), F.substring_index(t, "!", 1)).otherwise(F.substring(t, 1, 100))


def language(text: Column) -> Column:
    """The language of a code block, by its fence or its content."""
    tag = F.lower(F.regexp_extract(text, r"```(\w+)", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for k, v in (("py", "python"), ("python", "python"), ("js", "javascript"), ("javascript", "javascript"), ("ts", "typescript"), ("sql", "sql"), ("sh", "shell"), ("bash", "shell"), ("go", "go"), ("rust", "rust")) for x in (k, v)]), tag)
    return F.coalesce(known, F.when(text.rlike(r"(?m)^\s*(def |import |class )"), "python").when(text.rlike(r"\b(function|const|let)\b.*[;{]"), "javascript").when(text.rlike(r"(?i)\bselect\b.*\bfrom\b"), "sql").otherwise("text"))


def arithmetic_claims(text: Column) -> Column:
    """Claims `a op b = c` with the value they should have and whether they hold."""
    found = F.regexp_extract_all(text, F.lit(r"((?:-?\d+(?:\.\d+)?)\s*[-+*/]\s*(?:-?\d+(?:\.\d+)?)\s*=\s*(?:-?\d+(?:\.\d+)?))"), F.lit(1))

    def check(c: Column) -> Column:
        g = lambda i: F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)\s*([-+*/])\s*(-?\d+(?:\.\d+)?)\s*=\s*(-?\d+(?:\.\d+)?)", i)
        a, op, b, said = g(1).cast("double"), g(2), g(3).cast("double"), g(4).cast("double")
        value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).otherwise(a / F.nullif(b, F.lit(0.0)))
        return F.struct(c.alias("claim"), value.alias("value"), (F.abs(value - said) < 1e-6).alias("holds"))

    return F.transform(found, check)


def url_normalize(url: Column, suffix: str = "") -> Column:
    """A URL with a scheme, without closing slashes, ending in the suffix."""
    u = F.trim(url)
    u = F.when(u.rlike("^[a-zA-Z]+://"), u).otherwise(F.concat(F.lit("http://"), u))
    u = F.regexp_replace(u, "/+$", "")
    return F.when(u.endswith(suffix), u).otherwise(F.concat(u, F.lit(suffix))) if suffix else u


#: Where a service is taken to run if nothing else is said.  Fixed values.
PORT, VERSION = 11434, "/v1"


def base_url(raw: Column) -> Column:
    """What a user types for a service as its base URL: a bare host gets a scheme and the default port, a URL without a version gets one, nothing is the local service."""
    s = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "/+$", "")
    whole = F.when(F.contains(s, F.lit("://")), s).otherwise(F.concat(F.lit("http://"), s, F.when(F.contains(s, F.lit(":")), "").otherwise(f":{PORT}")))
    tail = F.regexp_extract(whole, r"(?s)^.*?://(.*)$", 1)
    return F.when(s == "", f"http://localhost:{PORT}{VERSION}").when(F.contains(tail, F.lit(VERSION)), whole).otherwise(F.concat(whole, F.lit(VERSION)))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)


def is_local(url: Column) -> Column:
    return host(url).rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def module_candidates(path: Column) -> Column:
    """All dotted module names that a path can be imported by, longest first."""
    p = F.split(F.regexp_replace(F.regexp_replace(path, r"\.\w+$", ""), r"^/+", ""), "/")
    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))).otherwise(F.array().cast("array<string>"))


def prefixes(dotted: Column) -> Column:
    """a.b.c as [a, a.b, a.b.c]."""
    p = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "."))


def truncate_repetition(text: Column, runs: int = 4) -> Column:
    """The text up to the first word that is said `runs` times on end, if enough stands before it."""
    pattern = r"(?s)^(.{51,}?)(?<=\s)(\S+)(?:\s+\2){%d,}(?=\s|$).*$" % (runs - 1)
    long = (F.length(text) >= 100) & (F.size(words(text)) >= 20)
    return F.when(long, F.rtrim(F.regexp_replace(text, pattern, "$1"))).otherwise(text)
