"""Ranked retrieval: BM25, overlap, reciprocal-rank fusion and reranking, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .store import settled

K1, B, RRF_K = 1.5, 0.75, 60
#: Terms that are looked for in place, at most.
FEW = 200


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) of documents that hold a term of a query (query_id, term).

    Texts are cut into words once: what a document's length and its hits are is
    written without the text, and both the corpus statistics (one row) and the
    counts come from there.  Up to `FEW` terms are looked for in place; more are
    joined.
    """
    asked = queries.select("term").distinct()
    terms = [r[0] for r in asked.limit(FEW + 1).collect()]
    sized = docs.select(key, words(F.col(text)).alias("w"))
    if len(terms) <= FEW:
        wanted = F.array(*[F.lit(x) for x in terms]).cast("array<string>")
        sized = sized.select(key, F.size("w").alias("dl"), F.filter("w", lambda x: F.array_contains(wanted, x)).alias("hits"))
    else:
        sized = sized.select(key, F.size("w").alias("dl"), F.col("w").alias("hits"))
    sized = settled(sized)
    stats = sized.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    met = sized.select(key, "dl", F.explode("hits").alias("term"))
    tf = (met if len(terms) <= FEW else met.join(asked, "term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(stats)).join(queries, "term")  # statistics are one row
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", key).agg(F.sum(part).alias("score"))


def top(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], group: str, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of rankings (group, key, rank)."""
    rows = rankings[0].select(group, key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(group, key, "rank"))
    return rows.groupBy(group, key).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"))


def rerank(rrf: Column, best: Column, name_hit: Column, class_hit: Column, header_hits: Column, recent: Column, test_path: Column, test_intent: Column) -> Column:
    """The fused score, scaled, with boosts for names, headers and recent files and a penalty for tests."""
    boost = F.when(name_hit, 0.25).otherwise(0.0) + F.when(class_hit, 0.20).otherwise(0.0) + F.least(F.lit(0.15), header_hits * 0.05) + F.when(recent, 0.10).otherwise(0.0) - F.when(test_path & ~test_intent, 0.30).otherwise(0.0)
    return rrf / best + boost


def lexical_score(terms: Column, asked: list[str]) -> Column:
    """Overlap with a query and its density among a text's distinct words."""
    distinct = F.array_distinct(terms)
    overlap = F.size(F.array_intersect(distinct, F.array(*[F.lit(a) for a in asked])))
    return overlap + overlap / (1 + F.sqrt(F.size(distinct)))
