"""The operators as stages of a corpus pipeline: documents in, documents out.

Defined cases, for all of them: docs has `COLUMNS`, any of which may be null,
and maybe others, which are left out whatever their names; rows that share an
id are rows of their own; a null text stays null; an empty table gives an empty
table.  A stage changes no document but where it says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, mixing, packing, quality, secrets
from .common import keyed, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates in the pipeline: words of a shingle and percent of shared shingles.
SHINGLE, NEAR = 5, 80
#: Row numbers from here on are of rows without an id of their own.
SPARE = 1 << 62
#: Rows that are broadcast at most.
FEW = 100_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; it is fitted on this stage's documents and the labels.

    Without any label every score is 0.5, and none is accepted.  Equal texts share their fate.
    """
    fitted = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, fitted, *COLUMNS).where(F.col("score") >= quality.ACCEPT).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id; of rows equal in id and text, one.

    Groups are of rows, not of ids: a null id, or an id that several texts
    share, gets numbers of its own after all others, so a text without a near
    copy stays whatever its id.  Null and empty texts are nobody's copies.
    """
    rows = keyed(docs, "lang", "source", "n_chars")
    several = rows.groupBy("_id").agg(F.min("_key").alias("least"), F.max("_key").alias("most")).where("least <> most").select("_id", "least")
    several = materialize(several, "several")
    if several.count() <= FEW:  # so that the documents need no shuffle for it
        several = F.broadcast(several)
    number = F.when((F.col("_id") < SPARE) & (F.col("least").isNull() | (F.col("least") == F.col("_key"))), F.col("_id")).otherwise(SPARE + F.pmod(F.xxhash64("_id", "_key"), F.lit(SPARE - 1)))
    rows = rows.join(several, "_id", "left").withColumn("_row", number).drop("least")
    found = jaccard_join.jaccard_join(rows.select(F.col("_row").alias("doc_id"), "text"), words=SHINGLE, percent=NEAR)
    kept = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_row")).agg(F.count("*").alias("times"))
    met = rows.join(kept, "_row")
    # rows that stand several times are few; only they are grouped with their texts
    return met.where("times = 1").select(*COLUMNS).unionByName(met.where("times > 1").dropDuplicates(["_row"]).select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a sign in place of every secret; n_chars follows the text."""
    return secrets.mask(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole pass that takes a document, and one for its part of the last pass, cut to its words.

    Documents without words add nothing to a mix and are left out; null is a source of its own.
    Rows equal in id, text and source are taken together, each with its own share.
    """
    keys = ["_id", "_key", "_source"]
    plan = mixing.mix(docs).groupBy(F.coalesce("doc_id", F.lit(jaccard_join.NULL_ID)).alias("_id"), "_key", F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), "size", "epochs", "part").agg(F.count("*").alias("m"))
    # equal rows differ at most in their parts: all, nothing, and what is left at the border
    plan = plan.groupBy(*keys, "_none", "size").agg(F.sum("m").alias("times"), F.collect_list(F.struct("epochs", "part", "m")).alias("shares")).where("exists(shares, s -> s.epochs > 0 OR s.part > 0)")
    rows = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(jaccard_join.NULL_ID)).alias("_id"), F.xxhash64("text").alias("_key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_none")).join(plan, [*keys, "_none"])
    rows = rows.where("times = 1").unionByName(rows.where("times > 1").dropDuplicates([*keys, "_none"]))
    takes = F.expr("flatten(transform(shares, s -> concat(array_repeat(size, cast(s.epochs * s.m as int)), CASE WHEN s.part > 0 THEN array_repeat(s.part, cast(s.m as int)) ELSE cast(array() as array<bigint>) END)))")
    out = rows.withColumn("take", F.explode(takes))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), 1, F.col("take").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("take") >= F.col("size"), F.col("text")).otherwise(cut))
    return out.withColumn("n_chars", F.when(F.col("take") >= F.col("size"), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the pieces of all documents in sequences (see `packing.pack`)."""
    return packing.pack(docs, packing.default_tokenizer())
