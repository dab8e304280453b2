"""Reports and gates over findings, facts, functions and attempts; each takes the columns it works on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hits
from .scan import lookup


def capped(parts: list[tuple[str, DataFrame, str, int, list[Column]]]) -> DataFrame:
    """(kind, id): of each (kind, rows, id, most, order) the first rows in its order."""
    return reduce(DataFrame.unionByName, [rows.orderBy(*order).limit(most).select(F.lit(kind).alias("kind"), F.col(key).alias("id")) for kind, rows, key, most, order in parts])


def worst_first(rows: DataFrame, rank: Column, floor: int, key: str, most: int) -> DataFrame:
    """Rows whose rank is `floor` or more, the highest first, `most` of them: what is worth reasoning about."""
    return rows.withColumn("_rank", F.coalesce(rank, F.lit(-1))).where(F.col("_rank") >= floor).orderBy(F.desc("_rank"), key).limit(most).drop("_rank")


def dead(functions: DataFrame, key: str, name: str, used: DataFrame, alive: str, order: list[Column], most: int) -> DataFrame:
    """Functions that nothing in used (key) calls and whose names do not match `alive`."""
    return functions.where(~F.col(name).rlike(alive)).join(used.select(key).distinct(), key, "left_anti").orderBy(*order).limit(most)


def markdown_counts(rows: DataFrame, column: str) -> DataFrame:
    """`line`: a row of a Markdown table for each value and its count."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).select(F.concat(F.lit("| "), F.col(column).cast("string"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))


def strongest(rows: DataFrame, key: str, capability: str, weights: dict[str, int]) -> DataFrame:
    """(key, stage): the capability of the largest weight, unknown ones weigh nothing."""
    weight = F.coalesce(lookup(weights, F.col(capability)), F.lit(0))
    return rows.groupBy(key).agg(F.max_by(capability, F.struct(weight.alias("w"), capability)).alias("stage"))


def verdicts(claims: DataFrame, claim: str, facts: DataFrame, fact: str, wrong: Column) -> DataFrame:
    """(claim, verdict): missing without a fact, wrong size if the fact says otherwise, verified else."""
    met = claims.select(claim).distinct().join(facts, F.col(claim) == F.col(fact), "left")
    return met.select(claim, F.when(F.col(fact).isNull(), "missing").when(wrong, "wrong size").otherwise("verified").alias("verdict"))


def echo(rows: DataFrame, key: str, echoed: str, total: str, most: float = 0.99) -> DataFrame:
    """(key, echoed, speedup): the share of tokens taken from the source and the speed-up that this may give."""
    share = F.sum(echoed) / F.sum(total)
    return rows.groupBy(key).agg(F.round(share, 6).alias("echoed"), F.round(1 / (1 - F.least(F.lit(most), share)), 6).alias("speedup"))


def best_named(rows: DataFrame, key: str, name: str, words: list[str], least: int, most: int = 1) -> DataFrame:
    """(key, hits): the rows whose names hold the most of the words, `least` of them at any rate."""
    return rows.select(key, hits(F.col(name), words).alias("hits")).where(F.col("hits") >= least).orderBy(F.desc("hits"), key).limit(most)


def active(rows: DataFrame, group: str, key: str, score: str, healthy: Column) -> DataFrame:
    """(group, active): the healthy row of the highest score."""
    return rows.where(healthy).groupBy(group).agg(F.max_by(key, F.struct(score, key)).alias("active"))


def solutions(rows: DataFrame, signature: str, score: str, digits: int = 12) -> DataFrame:
    """(key, tries, best): attempts under the digest of their signature, in lower case."""
    return rows.groupBy(F.substring(F.md5(F.lower(signature).cast("binary")), 1, digits).alias("key")).agg(F.count("*").alias("tries"), F.max(score).alias("best"))


def narrative(rows: DataFrame, column: str, words: dict[str, str], other: str, noun: str) -> DataFrame:
    """(column, narrative): a phrase for each value and how often it stands."""
    word = F.coalesce(lookup(words, F.col(column)), F.lit(other))
    return rows.groupBy(column).agg(F.count("*").alias("n")).select(column, F.concat(word, F.lit(f" {noun}: "), F.col("n").cast("string")).alias("narrative"))


def read_verdict(reply: Column) -> Column:
    """verdict, confidence, reasoning and fix of a model's reply, each empty (or null) where it does not say so."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    low = F.lower(text)
    said = F.regexp_extract(low, r"verdict\s*[:\-]\s*([a-z_ ]+)", 1)
    marked = low.rlike(r"verdict\s*[:\-]\s*[a-z_ ]+")
    word = F.when(marked, F.trim(said)).otherwise(F.substring(low, 1, 20))
    first = F.get(F.filter(F.split(word, r"\s+"), lambda w: w != ""), F.lit(0))
    verdict = F.when(F.contains(word, F.lit("not")) | first.isin("no", "safe", "false"), "not_exploitable").when(first.isin("exploitable", "yes", "vulnerable", "real"), "exploitable")
    verdict = F.coalesce(verdict, F.when(word.startswith("uncert") | first.isin("maybe", "unclear") | marked, "uncertain"), F.lit(""))
    number = F.regexp_extract(low, r"confidence\s*[:\-]\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    part = lambda pattern: F.substring(F.trim(F.regexp_extract(text, pattern, 1)), 1, 600)
    reasoning, fix = part(r"(?is)reasoning\s*[:\-]\s*(.+?)(?=\n\s*fix\s*[:\-]|\z)"), part(r"(?is)fix\s*[:\-]\s*(.+)")
    return F.struct(verdict.alias("verdict"), F.when(number > 1, number / 100).otherwise(number).alias("confidence"), reasoning.alias("reasoning"), fix.alias("fix"))


def reasoned(findings: DataFrame, reply: str, confidence: str, deep: str | None = None) -> DataFrame:
    """findings with a model's verdict, reasoning and fix, and the confidence that follows; what is cleared for certain goes.

    A deeper model's reply (column `deep`) counts where the first one is uncertain
    or says nothing, if it says something; `escalated` tells so.
    """
    first = read_verdict(F.col(reply))
    rows = findings.withColumn("_v", first).withColumn("_d", read_verdict(F.col(deep)) if deep else F.lit(None).cast("struct<verdict:string,confidence:double,reasoning:string,fix:string>"))
    rows = rows.withColumn("escalated", F.col("_v.verdict").isin("", "uncertain") & (F.coalesce("_d.verdict", F.lit("")) != "")).withColumn("_v", F.when(F.col("escalated"), F.col("_d")).otherwise(F.col("_v")))
    surer = F.least(F.lit(1.0), F.greatest(F.col(confidence), F.coalesce("_v.confidence", F.lit(0.9))))
    doubtful = F.least(F.col(confidence), F.coalesce("_v.confidence", F.lit(0.25)), F.lit(0.25))
    now = F.when(F.col("_v.verdict") == "exploitable", surer).when(F.col("_v.verdict") == "not_exploitable", doubtful).otherwise(F.col(confidence))
    out = rows.withColumns({confidence: now, "verdict": F.col("_v.verdict"), "reasoning": F.col("_v.reasoning"), "fix": F.col("_v.fix")}).drop("_v", "_d")
    return out.where((F.col("verdict") != "not_exploitable") | (F.col(confidence) >= 0.4))
