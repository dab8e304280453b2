"""What answers claim about code, and whether the project bears it out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import rows_of

#: Patterns of each kind of claim, in the order in which they are tried, and words that name no function.  Fixed values.
PATTERNS = (
    ("function", r"(?:the\s+)?[`\"]?(\w{3,})\(\)[`\"]?\s+(?:function|method)"),
    ("function", r"(?:the\s+)?[`\"]?(\w{3,})[`\"]?\s+(?:function|method)"),
    ("function", r"(?:function|method|def)\s+[`\"]?(\w{3,})[`\"]?"),
    ("function", r"[`](\w{3,})\(\)[`]"),
    ("class", r"(?:the\s+)?[`\"]?(\w{3,})[`\"]?\s+class"),
    ("class", r"class\s+[`\"]?(\w{3,})[`\"]?"),
    ("parameter_count", r"[`\"]?(\w{3,})\(\)[`\"]?\s+takes\s+(\d+)\s+(?:parameter|argument)"),
    ("parameter_count", r"[`\"]?(\w{3,})[`\"]?\s+takes\s+(\d+)\s+(?:parameter|argument)"),
    ("parameter_count", r"[`\"]?(\w{3,})[`\"]?\s+(?:accepts|expects|requires)\s+(\d+)\s+(?:parameter|argument)"),
    ("file", r"(?:in|from|file)\s+[`\"]?(\w+\.py)[`\"]?"),
    ("file", r"[`\"](\w+\.py)[`\"]"),
    ("return_type", r"[`\"]?(\w{3,})\(\)[`\"]?\s+returns?\s+(?:a\s+)?[`\"]?(\w+)[`\"]?"),
)
NO_FUNCTIONS = (
    "the", "this", "that", "from", "with", "your", "will", "can", "does", "not", "and", "for", "are", "has", "its", "use", "new", "get", "set", "all", "any", "run", "add",
    "let", "var", "def", "int", "str", "list", "dict", "none", "true", "false", "self", "main", "test", "print", "type", "input", "output", "error", "value", "return", "import",
)
MOST = 10
_PATTERNS = [(kind, re.compile(p, re.IGNORECASE)) for kind, p in PATTERNS]


def claims_of(text: str | None) -> list[tuple[int, str, str, str]]:
    """(place, kind, name, detail) of the first `MOST` different claims of a text."""
    found: dict[tuple[str, str], str] = {}
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text or ""):
            name = m[1]
            if kind == "function" and name.lower() in NO_FUNCTIONS or kind == "class" and not name[0].isupper():
                continue
            found.setdefault((kind, name), m[2] if pattern.groups > 1 else "")
    return [(i, kind, name, detail) for i, ((kind, name), detail) in enumerate([*found.items()][:MOST])]


def extracted(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, kind, name and detail of what each answer claims."""
    return rows_of(answers, key, text, claims_of, "array<struct<place:int,kind:string,name:string,detail:string>>")


def verified(claims: DataFrame, symbols: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """claims with `status` (verified, corrected, or null where there is nothing to hold them against) and `known`, what the project has.

    A name counts as it stands, else in any case (which corrects it); of several
    functions of a name the first one's arguments and result count.  A file is one
    whose name ends as claimed.  Names meet one row each, however often they stand,
    and are merged: Spark would judge the ends of names by the files' table.
    """
    whole = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    functions = symbols.where("kind = 'function'").select(F.explode(F.array_distinct(F.array("name", whole))).alias("known"), F.lit("function").alias("of"), F.struct(F.col(path).alias("path"), "place", F.size("args").alias("args"), F.coalesce("returns", F.lit("")).alias("returns")).alias("first"))
    classes = symbols.where("kind = 'class'").select(F.col("name").alias("known"), F.lit("class").alias("of"), F.struct(F.col(path).alias("path"), "place", F.lit(0).alias("args"), F.lit("").alias("returns")).alias("first"))
    facts = functions.unionByName(classes).groupBy("of", "known").agg(F.min("first").alias("first"))
    low = facts.groupBy("of", F.lower("known").alias("low")).agg(F.min_by(F.struct("known", "first"), F.col("known")).alias("any"))
    ends = F.regexp_extract(path, "[^/]*$", 0)
    suffixes = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(ends))), lambda i: F.substring(ends, i, F.lit(1 << 30)))).alias("known"), F.col(path).alias("file")).groupBy("known").agg(F.min("file").alias("file"))

    rows = claims.withColumn("of", F.when(F.col("kind").isin("function", "parameter_count", "return_type"), "function").when(F.col("kind") == "class", "class")).withColumn("low", F.lower("name"))
    met = rows.join(facts.select("of", F.col("known").alias("name"), F.col("first").alias("exact")).hint("merge"), ["of", "name"], "left").join(low.hint("merge"), ["of", "low"], "left").join(suffixes.withColumnRenamed("known", "name").hint("merge"), "name", "left")
    fact = F.coalesce("exact", "any.first")
    named = F.when(F.col("exact").isNotNull(), F.struct(F.lit("verified").alias("status"), F.col("exact.path").alias("known"))).when(F.col("any").isNotNull(), F.struct(F.lit("corrected").alias("status"), F.col("any.known").alias("known")))
    counted = F.when(fact.isNotNull() & (fact["args"] > 0), F.struct(F.when(fact["args"] == F.col("detail").try_cast("int"), "verified").otherwise("corrected").alias("status"), fact["args"].cast("string").alias("known")))
    typed = F.when(fact.isNotNull() & (fact["returns"] != ""), F.struct(F.when(F.contains(F.lower(fact["returns"]), F.lower("detail")), "verified").otherwise("corrected").alias("status"), fact["returns"].alias("known")))
    filed = F.when((F.col("kind") == "file") & F.col("file").isNotNull(), F.struct(F.lit("verified").alias("status"), F.col("file").alias("known")))
    found = F.when(F.col("kind").isin("function", "class"), named).when(F.col("kind") == "parameter_count", counted).when(F.col("kind") == "return_type", typed).otherwise(filed)
    return met.withColumn("v", found).select(*claims.columns, "v.status", "v.known")
