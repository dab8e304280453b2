"""What answers a question before any model does: known facts, history sections, names looked up, and whether an index is stale."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a question that ask for a section of the history.  Fixed values.
HISTORY = {
    "recent": ("recent", "today", "week", "yesterday", "last"),
    "file": ("why", "changed", "modify", "history"),
    "hotspots": ("hotspot", "frequent", "most changed"),
    "commit": ("commit", "staged", "changes"),
}
#: Questions about the user by the fact that answers them, with the answer's form.  Fixed values.
ASKED = {
    "name": (("my name", "who am i", "what's my name"), "Your name is %s."),
    "location": (("where am i", "my location", "where do i live"), "You're in %s."),
    "job": (("my job", "what do i do", "where do i work"), "You work as %s."),
}
#: Forms in which a text names a function; the name is the group.
NAMED = (r"(\w{3,})\(\)", r"(?:function|method|def)\s+[`\"]?(\w{3,})", r"what does\s+[`\"]?(\w{3,})[`\"]?\s+do", r"how does\s+[`\"]?(\w{3,})[`\"]?\s+work", r"explain\s+[`\"]?(\w{3,})")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def history_sections(question: Column) -> Column:
    """The sections that a question asks for, in the table's order; the file section needs a word with a dot; none asked for means recent."""
    q = F.coalesce(F.lower(question), F.lit(""))
    file = F.exists(F.split(q, r"\s+"), lambda w: F.contains(w, F.lit(".")) & ~F.startswith(w, F.lit(".")))
    found = F.array_compact(F.array(*[F.when(_any(q, words) & (file if name == "file" else F.lit(True)), name) for name, words in HISTORY.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("recent")))


def recent_days(question: Column) -> Column:
    """How many days back the recent section goes."""
    return F.when(_any(F.coalesce(F.lower(question), F.lit("")), ("today", "yesterday")), 1).otherwise(7)


def answer_about_user(question: Column, profile: dict[str, Column]) -> Column:
    """The answer of the first known fact that a question asks for, else null."""
    q = F.coalesce(F.lower(question), F.lit(""))
    return F.coalesce(*[F.when(_any(q, words), F.when(profile[k].isNotNull(), F.format_string(form, profile[k]))) for k, (words, form) in ASKED.items() if k in profile], F.lit(None).cast("string"))


def learn(facts: DataFrame, text: str, confidence: float = 0.9) -> DataFrame:
    """Facts as entities: a stable id, a name of 60 characters, the whole text; a fact that is told twice is one."""
    whole = F.trim(F.col(text))
    rows = facts.where(F.length(whole) > 0).select(F.concat(F.lit("fact_"), F.substring(F.md5(whole.cast("binary")), 1, 10)).alias("id"), F.substring(whole, 1, 60).alias("name"), F.lit("fact").alias("entity_type"), whole.alias("full_text"), F.lit(confidence).alias("confidence"))
    return rows.dropDuplicates(["id"])


def gather(questions: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, name, ...) of the known names (name, ...) that questions mention in one of the forms."""
    said = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(p), F.lit(1)) for p in NAMED])))
    asked = questions.select(key, F.explode(said).alias("said"))
    return asked.join(names, F.col("said") == F.lower("name")).drop("said")


def stale(chunks: DataFrame, dims: int, signature: str) -> DataFrame:
    """One row, `stale`: whether vectors (vec) have other dimensions than the embedder, or no Python chunk (language, text) bears the chunker's signature."""
    other = F.coalesce(F.max((F.size("vec") != dims).cast("int")), F.lit(0)) == 1
    python = F.col("language") == "python"
    unsigned = (F.count(F.when(python, 1)) > 0) & (F.count(F.when(python & F.contains("text", F.lit(signature)), 1)) == 0)
    return chunks.agg((other | unsigned).alias("stale"))


#: Key words and snippets by language.  Fixed values.
KEYWORDS = {
    "python": ("def ", "class ", "if ", "elif ", "else:", "for ", "while ", "try:", "except ", "finally:", "with ", "as ", "import ", "from ", "return ", "yield ", "raise ", "pass", "break", "continue", "lambda ", "async ", "await ", "assert ", "global ", "nonlocal "),
    "js": ("function ", "const ", "let ", "var ", "if ", "else ", "for ", "while ", "return ", "import ", "export ", "class ", "async ", "await ", "try ", "catch ", "switch ", "case ", "default:", "throw ", "new "),
    "go": ("func ", "type ", "struct ", "interface ", "var ", "const ", "if ", "else ", "for ", "range ", "return ", "switch ", "case ", "default:", "defer ", "go ", "select ", "chan ", "map[", "make("),
}
BUILTINS = ("print(", "len(", "range(", "str(", "int(", "float(", "list(", "dict(", "set(", "tuple(", "type(", "isinstance(", "hasattr(", "getattr(", "setattr(", "enumerate(", "zip(", "map(", "filter(", "sorted(", "reversed(", "any(", "all(", "min(", "max(", "sum(", "abs(", "round(", "open(", "input(", "super(", "property(", "classmethod(", "staticmethod(", "dataclass(")
SNIPPETS = {
    "def": "def ${1:name}(${2:args}):\n    ${3:pass}",
    "class": "class ${1:Name}:\n    def __init__(self${2:}):\n        ${3:pass}",
    "if": "if ${1:condition}:\n    ${2:pass}",
    "for": "for ${1:item} in ${2:items}:\n    ${3:pass}",
    "with": "with ${1:context} as ${2:var}:\n    ${3:pass}",
    "try": "try:\n    ${1:pass}\nexcept ${2:Exception} as e:\n    ${3:pass}",
    "main": 'if __name__ == "__main__":\n    ${1:main()}',
    "init": "def __init__(self${1:}):\n    ${2:pass}",
    "test": "def test_${1:name}(${2:}):\n    assert ${3:True}",
    "async": "async def ${1:name}(${2:args}):\n    ${3:pass}",
    "dataclass": "@dataclass\nclass ${1:Name}:\n    ${2:field}: ${3:str}",
}


def completion_rows() -> list[tuple[str, str, str, str, str]]:
    """(language, text, kind, label, inserted) of what can be completed; `*` is any language, and unknown ones have the key words of Python without its built-in names."""
    words = {"python": KEYWORDS["python"] + BUILTINS, "js": KEYWORDS["js"], "go": KEYWORDS["go"], "other": KEYWORDS["python"]}
    out = [(language, w.strip(), "keyword", w.strip(), w) for language, known in words.items() for w in known]
    return out + [("*", trigger, "snippet", "⚡ " + re.sub(r"\$\{[123]:|\}", "", text.split("\n")[0]), text) for trigger, text in SNIPPETS.items()]


def complete(typed: DataFrame, key: str, prefix: str, language: str) -> DataFrame:
    """key, text, kind, label and inserted of every completion of what is typed, but for itself."""
    known = F.when(F.col(language).isin("python", "go"), F.col(language)).when(F.col(language).isin("javascript", "typescript", "js", "ts"), "js").otherwise("other")
    table = typed.sparkSession.createDataFrame(completion_rows(), "_language string, text string, kind string, label string, inserted string")
    begins = F.startswith(F.lower("text"), F.lower(F.col(prefix))) & (F.lower("text") != F.lower(F.col(prefix)))
    met = typed.withColumn("_known", F.explode(F.array(known, F.lit("*")))).join(F.broadcast(table), (F.col("_known") == F.col("_language")) & begins)  # a fixed table of some hundred rows
    return met.select(key, "text", "kind", "label", "inserted")
