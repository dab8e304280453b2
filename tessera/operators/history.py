"""Analytics over commits and the files they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hotspots(commits: DataFrame, files: DataFrame, last: int = 100, top: int = 10) -> DataFrame:
    """Commits per file among the last commits (commit, ts; commit, file)."""
    recent = commits.orderBy(F.desc("ts"), F.desc("commit")).limit(last).select("commit")
    return files.join(F.broadcast(recent), "commit").groupBy("file").agg(F.count_distinct("commit").alias("changes")).orderBy(F.desc("changes"), "file").limit(top)


def co_evolution(files: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of files by shared commits, with Jaccard and strength.  Items with fewer commits than `least` cannot qualify and are dropped before the join."""
    each = files.distinct()
    count = each.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = each.join(count, "file")
    a, b = kept.select("commit", F.col("file").alias("a"), F.col("n").alias("na")), kept.select("commit", F.col("file").alias("b"), F.col("n").alias("nb"))
    pair = a.join(b, "commit").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    jaccard = F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 3)
    return pair.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"), jaccard.alias("jaccard"), F.when(jaccard >= 0.7, "strong").when(jaccard >= 0.35, "moderate").otherwise("weak").alias("strength"))


def stability(changes: DataFrame, now: int) -> DataFrame:
    """Per file of (file, epoch): age, changes, rate a month and a score of 0 to 100."""
    g = changes.groupBy("file").agg(F.count("*").alias("changes"), F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    g = g.withColumn("age_days", F.greatest(F.lit(1), F.floor((F.lit(now) - F.col("first")) / 86400))).withColumn("quiet_days", F.greatest(F.lit(0), F.floor((F.lit(now) - F.col("last")) / 86400)))
    rate = F.col("changes") / F.col("age_days") * 30
    raw = 100 - F.least(F.lit(100.0), rate * 10) + F.least(F.lit(30.0), F.col("quiet_days") / 30 * 5)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw).cast("int")))
    label = F.when(score >= 80, "very stable").when(score >= 60, "moderately stable").when(score >= 40, "active").when(score >= 20, "volatile").otherwise("extremely volatile")
    return g.select("file", "age_days", "changes", F.round(rate, 2).alias("monthly"), "quiet_days", score.alias("score"), label.alias("label"))


def bus_factor(counts: DataFrame, keys: list[str], share: float = 0.8) -> DataFrame:
    """The least number of authors, most active first, that made `share` of the commits (keys, author, commits)."""
    by = Window.partitionBy(*keys)
    run = by.orderBy(F.desc("commits"), "author").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("commits").over(run)).withColumn("all", F.sum("commits").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("commits"), "author")))
    return ranked.where(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(F.min("rank").alias("bus_factor"))


def overlaps(hunks: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Hunks (start, count) that touch ranges (first, last) of one file: a hash join on the file with the interval test as its residual."""
    end = F.col("start") + F.greatest(F.col("count"), F.lit(1)) - 1
    return hunks.join(ranges, key).where((F.col("start") <= F.col("last")) & (end >= F.col("first")))


def change_class(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.rlike("feat|add|signup"), "feat").when(m.rlike("fix|bug|error"), "fix").otherwise("other")


#: Words of messages and files that raise or lower suspicion.  Fixed values.
RISKY = ("refactor", "rewrite", "overhaul", "redesign", "migration", "replace", "remove", "delete", "breaking", "major", "merge", "conflict", "hotfix", "hack", "workaround", "temp")
CONFIG = ("config", "env", ".yml", ".yaml", ".toml", "settings", "dockerfile", "requirements", "package.json")
TRIVIAL = ("readme", "docs", "comment", "typo", "formatting", "lint", "style")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def suspicion(message: Column, files: Column, changes: Column, bug: str, hints: tuple[str, ...]) -> Column:
    """How likely a commit caused a bug, 0 to 1, from its words, files and size."""
    m = F.lower(message)
    words = F.filter(F.array_distinct(F.split(m, r"\s+")), lambda w: w != "")
    asked = F.array(*[F.lit(w) for w in sorted(set(bug.lower().split()))])
    hit = F.size(F.filter(files, lambda f: any_of(F.lower(f), hints))) if hints else F.lit(0)
    score = F.least(F.size(F.array_intersect(words, asked)) * 0.15, F.lit(0.45)) + hit * 0.2
    score += F.when(changes > 100, 0.15).when(changes > 50, 0.10).when(changes > 20, 0.05).otherwise(0.0)
    score += F.when(any_of(m, RISKY), 0.15).otherwise(0.0) + F.when(F.exists(files, lambda f: any_of(F.lower(f), CONFIG)), 0.05).otherwise(0.0)
    return F.least(F.when(any_of(m, TRIVIAL) & (changes < 20), score * 0.3).otherwise(score), F.lit(1.0))
