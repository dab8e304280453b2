"""The nearest known name of a misspelt one, and code in which such names are set right.

Two names of ratio r have 2 M / (a + b) >= r for M common characters in order,
so at most a + b - 2 M characters stand alone, which cut what is common into
pieces: at least M - (a + b - 2 M) - 1 pairs of neighbouring letters are shared.
Each name is looked up by so many of its rarest pairs that none of such partners
is missed, whatever the letter that differs; pairs that most names have are not
looked up, and no two names meet for a common first letter.
"""

from __future__ import annotations

import builtins
import difflib
import json
import keyword
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settled

#: How alike names are at least, and how long the known one may be, against the other.
RATIO, SHORT, LONG = 0.85, 0.7, 1.4
#: Names that are nobody's misspelling: what the language itself has.
SKIPPED = tuple(sorted({x.lower() for x in (*dir(builtins), *keyword.kwlist, *keyword.softkwlist)}))
#: How names of new code begin.  Fixed values.
INVENTED = ("new_", "custom_", "my_", "create_", "build_", "setup_", "init_", "test_")


def shared_pairs(length: int, ratio: float = RATIO) -> int:
    """The pairs of neighbouring letters that a name of this length shares, at least, with any name as alike as `ratio`."""
    least = None
    for other in range(1, 4 * length + 2):
        common = math.ceil(round(ratio * (length + other) / 2, 9))
        if common <= min(length, other):
            need = common - (length + other - 2 * common) - 1
            least = need if least is None else min(least, need)
    return max(1, least or 0)


def _pairs(names: DataFrame) -> DataFrame:
    """(low, pair, nth) of each name in lower case: its pairs of letters, equal ones numbered."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("low") - 1), lambda i: F.substring(F.col("low"), i, F.lit(2)))
    return names.select("low", F.explode(F.when(F.length("low") > 1, pairs).otherwise(F.array("low"))).alias("pair")).groupBy("low", "pair").agg(F.count("*").alias("n")).select("low", "pair", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))


def closest(wanted: DataFrame, known: DataFrame, name: str = "name", ratio: float = RATIO, short: float = SHORT, long: float = LONG) -> DataFrame:
    """(name, match, ratio): the known name nearest to each wanted one, in any case, the least of equally near ones.

    Wanted names that are known as they stand, and those without a known name as
    alike as `ratio`, are left out.
    """
    asked = settled(wanted.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().join(known.select(F.col(name).alias("name")), "name", "left_anti").withColumn("low", F.lower("name")))
    have = settled(known.select(F.col(name).alias("known")).where("known IS NOT NULL").distinct().withColumn("low", F.lower("known")))
    exact = asked.join(have, "low").select("name", "known", F.lit(1.0).alias("r"))

    both = settled(_pairs(asked.select("low").union(have.select("low")).distinct()))
    often = both.groupBy("pair", "nth").agg(F.count("*").alias("often"))
    lengths = [shared_pairs(n, ratio) for n in range(257)]
    need = F.when(F.length("low") <= 256, F.get(F.array(*[F.lit(n) for n in lengths]), F.length("low"))).otherwise(1)
    ranked = both.join(often, ["pair", "nth"]).withColumn("rank", F.row_number().over(Window.partitionBy("low").orderBy("often", "pair", "nth")))
    keys = settled(ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.length("low") - 1) - need + 1).select("low", "pair", "nth"))
    left = keys.join(asked.select("low").distinct(), "low", "left_semi").withColumnRenamed("low", "a")
    right = keys.join(have.select("low").distinct(), "low", "left_semi").withColumnRenamed("low", "b")
    size = F.length("b") / F.length("a")
    pairs = left.join(right, ["pair", "nth"]).where((F.col("a") != F.col("b")) & size.between(short, long)).select("a", "b").distinct()
    common = F.least(F.length("a"), F.length("b")) * 2 / (F.length("a") + F.length("b"))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(a, b, strict=True)])

    near = settled(pairs.where(common >= ratio).withColumn("r", alike("a", "b")).where(F.col("r") >= ratio))
    met = near.join(asked.withColumnRenamed("low", "a"), "a").join(have.withColumnRenamed("low", "b"), "b").select("name", "known", "r")
    return exact.unionByName(met).groupBy("name").agg(F.min_by(F.struct("known", "r"), F.struct((-F.col("r")).alias("d"), "known")).alias("m")).select("name", F.col("m.known").alias("match"), F.col("m.r").alias("ratio"))


_CALL, _CLASS = r"\b([a-zA-Z_]\w{3,})\s*\(", r"\b([A-Z][a-zA-Z0-9]{3,})\b"


def corrected(blocks: DataFrame, key: str, code: str, functions: DataFrame, classes: DataFrame, ratio: float = RATIO, skipped: tuple[str, ...] = SKIPPED, invented: tuple[str, ...] = INVENTED) -> DataFrame:
    """key, code and corrections (name, match, kind): blocks of code with misspelt functions and classes of a project set right.

    functions and classes have a column name.  A name that is known, that the
    language has, or that begins as new code does is left alone, and so are the
    lines of comments; of each name the first place is mended.
    """
    lines = F.filter(F.split(F.coalesce(F.col(code), F.lit("")), "\n", -1), lambda x: ~F.ltrim(x).rlike(r"^(#|//|\*)"))
    bare = F.array_join(lines, "\n")
    found = lambda pattern, kind: F.transform(F.array_distinct(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1))), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    names = settled(blocks.select(key, F.explode(F.concat(found(_CALL, "function"), found(_CLASS, "class"))).alias("n")).select(key, "n.*").where(~F.lower("name").isin(*skipped)))
    new = F.exists(F.array(*[F.lit(x) for x in invented]), lambda p: F.startswith(F.lower("name"), p))
    matches = None
    for kind, known in (("function", functions), ("class", classes)):
        near = closest(names.where((F.col("kind") == kind) & ~new).select("name"), known, "name", ratio).select(F.lit(kind).alias("kind"), "name", "match")
        matches = near if matches is None else matches.unionByName(near)
    # a name that is known as the other kind is no misspelling
    matches = matches.join(functions.select("name").union(classes.select("name")).distinct(), "name", "left_anti")
    mine = names.join(matches, ["kind", "name"]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("kind", "name", "match"))).alias("corrections"))
    rows = blocks.select(key, F.col(code).alias("code")).join(mine, key, "left").withColumn("all", F.to_json("corrections"))
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, done = [], []
            for text, wrong in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                made, fixed = [], set()
                for c in sorted(json.loads(wrong or "[]"), key=lambda c: (c["kind"] != "function", c["name"])):
                    if text is None or c["name"] in fixed:
                        continue
                    mended = mend(text, c["name"], c["match"], c["kind"])
                    if mended != text:
                        text = mended
                        made.append({k: c[k] for k in ("name", "match", "kind")})
                        fixed.add(c["name"])
                out.append(text)
                done.append(made)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(done, pa.list_(pa.struct([(n, pa.string()) for n in ("name", "match", "kind")])))], names=[key, "code", "corrections"])

    return rows.select(key, "code", "all").mapInArrow(run, f"`{key}` {kind}, code string, corrections array<struct<name:string,match:string,kind:string>>")


def mend(code: str, name: str, match: str, kind: str) -> str:
    """code with the first place of a name, outside of lines of comments, replaced."""
    pattern = re.compile(rf"\b{re.escape(name)}\b" + (r"(?=\s*\()" if kind == "function" else ""))
    lines = code.split("\n")
    for i, line in enumerate(lines):
        if not line.lstrip().startswith(("#", "//", "*")) and pattern.search(line):
            lines[i] = pattern.sub(lambda _: match, line, count=1)
            break
    return "\n".join(lines)
