"""Retrieval queries over documents, parts and benchmark items."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import fuzzy, grams
from ..operators import retrieval as r
from ..operators import search_index, vectors
from .registry import Tables, query
from .text_queries import words_sql

TERMS = ("tionnd", "rely", "thble", "license")
_W = f"d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents)"
_BM = f"{_W}, s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), f AS (SELECT doc_id, dl, term, count(*) AS tf FROM t WHERE term IN ('tionnd', 'rely', 'thble', 'license') GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY term), b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM f JOIN g USING (term), s GROUP BY doc_id)"


def asked(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, w) for w in TERMS], "query_id int, term string")


def indexed(t: Tables) -> search_index.SearchIndex:
    """The words of all documents, indexed once for each state of the table's files."""
    return search_index.index_of(t.documents, "doc_id", "text", f"{t.sf_dir}/documents")


@query("t3_bm25", f"WITH {_BM} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25(t: Tables) -> DataFrame:
    return indexed(t).search({1: list(TERMS)}).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("t3_bm25_scan", f"WITH {_BM} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_scan(t: Tables) -> DataFrame:
    """The same without an index, from the texts."""
    return r.bm25(t.documents, "doc_id", "text", asked(t)).select("doc_id", F.round("score", 6).alias("score"))


@query("l13_bm25_topk", f"WITH {_BM} SELECT doc_id, round(score / (SELECT max(score) FROM b), 6) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, doc_id LIMIT 15")
def bm25_topk(t: Tables) -> DataFrame:
    best = r.top(indexed(t).search({1: list(TERMS)}).where("score > 0"), "query_id", 15, F.desc("score"), F.col("key"))
    return best.select(F.col("key").alias("doc_id"), F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6).alias("score"))


_KW = f"k AS (SELECT doc_id, len(list_intersect(list_distinct(w), ['tionnd', 'rely', 'thble', 'license'])) / 4 AS o FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents))"


@query("l9_keyword_topk", f"WITH {_KW} SELECT doc_id, o AS overlap FROM k WHERE o > 0 ORDER BY o DESC, doc_id LIMIT 20")
def keyword_topk(t: Tables) -> DataFrame:
    o = F.size(F.array_intersect(x.words(F.col("text")), x.literal(list(TERMS)))) / 4
    return t.documents.select("doc_id", o.alias("overlap")).where("overlap > 0").orderBy(F.desc("overlap"), "doc_id").limit(20)


@query("w1_rank_rrf", f"WITH {_BM}, {_KW}, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b QUALIFY rank <= 15), c AS (SELECT doc_id, row_number() OVER (ORDER BY o DESC, doc_id) AS rank FROM k WHERE o > 0 QUALIFY rank <= 15) SELECT doc_id, round(sum(1 / (60 + rank)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM c) GROUP BY doc_id")
def rank_rrf(t: Tables) -> DataFrame:
    found = indexed(t).search({1: list(TERMS)})
    by_score, by_hits = (Window.partitionBy("query_id").orderBy(o, "key") for o in (F.round("score", 9).desc(), F.desc("hits")))
    # both rankings of one search; a document that either has among its first counts
    ranked = found.select("query_id", "key", F.row_number().over(by_score).alias("a"), F.row_number().over(by_hits).alias("b")).where("a <= 15 OR b <= 15")
    part = lambda c: F.when(F.col(c) <= 15, 1 / (r.RRF_K + F.col(c))).otherwise(0.0)
    return ranked.select(F.col("key").alias("doc_id"), F.round(part("a") + part("b"), 9).alias("rrf"))


@query("t4_rerank_boosts", "SELECT p_partkey, round(1 / (60 + p_size) * 61 + CASE WHEN contains(p_name, 'red') THEN 0.25 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 0.2 ELSE 0 END + least(0.15, 0.05 * (contains(p_name, 'ring')::INT + contains(p_name, 'bolt')::INT)) - CASE WHEN p_brand = 'Brand#4' THEN 0.3 ELSE 0 END, 6) AS score FROM part")
def rerank_boosts(t: Tables) -> DataFrame:
    score = r.rerank(1 / (60 + F.col("p_size")), F.lit(1 / 61), F.contains("p_name", F.lit("red")), F.col("p_type") == "ECONOMY", x.hits(F.col("p_name"), ["ring", "bolt"]), F.lit(False), F.col("p_brand") == "Brand#4", F.lit(False))
    return t.part.select("p_partkey", F.round(score, 6).alias("score"))


@query("l19_lexical_rerank", f"WITH d AS (SELECT doc_id, list_distinct({words_sql('text')}) AS w FROM documents), s AS (SELECT doc_id, len(list_intersect(w, ['the', 'rely', 'und'])) AS o, len(w) AS n FROM d) SELECT doc_id, round(o + o / (1 + sqrt(n)), 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 5")
def lexical_rerank(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(r.lexical_score(x.words(F.col("text")), ["the", "rely", "und"]), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(5)


@query("w17_best_similar", f"WITH d AS (SELECT doc_id, list_distinct({words_sql('text')}) AS w FROM documents), b AS (SELECT item_id, list_distinct({words_sql('text')}) AS w FROM benchmark), s AS (SELECT item_id, doc_id, len(list_intersect(d.w, b.w)) / len(list_distinct(list_concat(d.w, b.w))) AS j FROM d, b), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) AS n FROM s WHERE j >= 0.05) SELECT item_id, doc_id, round(j, 6) AS jaccard FROM k WHERE n = 1")
def best_similar(t: Tables) -> DataFrame:
    """The document nearest to each item by shared words.

    Only pairs that share a word are formed, from postings; sizes give the union.
    """
    d = t.documents.select("doc_id", F.array_distinct(x.words(F.col("text"))).alias("w")).withColumn("nd", F.size("w"))
    b = t.benchmark.select("item_id", F.array_distinct(x.words(F.col("text"))).alias("w")).withColumn("nb", F.size("w"))
    shared = d.select("doc_id", "nd", F.explode("w").alias("t")).join(b.select("item_id", "nb", F.explode("w").alias("t")), "t").groupBy("item_id", "doc_id", "nd", "nb").agg(F.count("*").alias("o"))
    j = shared.withColumn("j", F.col("o") / (F.col("nd") + F.col("nb") - F.col("o"))).where("j >= 0.05")
    return r.top(j, "item_id", 1, F.desc("j"), F.col("doc_id")).select("item_id", "doc_id", F.round("j", 6).alias("jaccard"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' ')))"


@query("j22_shared_runs", f"WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents), b AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark), dg AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM d WHERE len(w) >= 5), bg AS (SELECT item_id, unnest({_GRAMS}) AS g FROM b WHERE len(w) >= 5) SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY ALL HAVING count(*) >= 8")
def shared_runs(t: Tables) -> DataFrame:
    """Documents that share at least eight five-word runs with an item."""
    return grams.shared_runs(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


_CUT = "regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')"


@query("j22_ngram_lookup", f"WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents), b AS (SELECT item_id, {_CUT} AS w FROM benchmark), g AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d), q AS (SELECT item_id, j - 1 AS place, array_to_string(w[j:j+4], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS j FROM b)), f AS (SELECT array_to_string(w[i:i+4], ' ') AS run, min({{'d': doc_id, 'i': i}}) AS spot FROM g WHERE array_to_string(w[i:i+4], ' ') IN (SELECT run FROM q) GROUP BY 1), h AS (SELECT run, spot.d AS source, spot.i AS i FROM f) SELECT item_id, place::INT AS place, source, (i + 4)::INT AS position, len(w[i+5:i+104])::INT AS n, md5(array_to_string(w[i+5:i+104], ' ')) AS next FROM q JOIN h USING (run) JOIN d ON doc_id = source")
def ngram_lookup(t: Tables) -> DataFrame:
    """Where each run of five words of an item first stands in a document with eight words left, and how that goes on."""
    asked = grams.windows(t.benchmark, "item_id", "text").withColumn("asked", F.struct("item_id", "place"))
    found = grams.echo(t.documents, "doc_id", "text", asked, "asked", "said")
    return found.select("asked.item_id", "asked.place", "source", "position", F.size("next").alias("n"), F.md5(F.array_join("next", " ").cast("binary")).alias("next"))


@query("l15_completions", "SELECT DISTINCT p_name AS text, CASE WHEN starts_with(p_name, 're') THEN 0 ELSE 1 END AS place FROM part WHERE contains(p_name, 're') ORDER BY 2, 1 LIMIT 10")
def completions(t: Tables) -> DataFrame:
    return t.part.where(F.contains("p_name", F.lit("re"))).select(F.col("p_name").alias("text"), F.when(F.col("p_name").startswith("re"), 0).otherwise(1).alias("place")).distinct().orderBy("place", "text").limit(10)


_TYPED = "n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, CASE v WHEN 0 THEN substring(name, 2) WHEN 1 THEN 'q' || name WHEN 2 THEN name || right(name, 1) ELSE upper(name) END AS typed FROM n, range(4) r(v))"


@query("l16_fuzzy_match", f"WITH {_TYPED} SELECT typed, min(name) AS match FROM t WHERE typed NOT IN (SELECT name FROM n) GROUP BY typed")
def fuzzy_match(t: Tables) -> DataFrame:
    """The nearest known name of each that lacks or has a letter too much, at either end, or is in capitals."""
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    typed = names.select(F.explode(F.array(F.expr("substring(name, 2)"), F.concat(F.lit("q"), "name"), F.concat("name", F.expr("right(name, 1)")), F.upper("name"))).alias("name"))
    return fuzzy.closest(typed, names).select(F.col("name").alias("typed"), "match")


@query("t6_hash_embedding")
def hash_embedding(t: Tables) -> DataFrame:
    """Feature hashing of words to 384 places, of unit length; the same text gives the same vector anywhere."""
    w = t.documents.select("doc_id", F.explode(x.words(F.col("text"))).alias("w"))
    c = w.select("doc_id", F.pmod(F.xxhash64("w"), F.lit(384)).cast("int").alias("place")).groupBy("doc_id", "place").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return c.select("doc_id", "place", (F.col("n") / norm).alias("x"))


@query("t7_hdc_encode")
def hdc_encode(t: Tables) -> DataFrame:
    return vectors.hypervectors(t.conversations, ["conv_id", "turn"], "text")


@query("t11_seq_ratio")
def seq_ratio(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        flat = lambda s: " ".join(str(s or "").lower().split())
        return pd.Series([1.0 if flat(p) == flat(q) else 0.0 if not flat(p) or not flat(q) else difflib.SequenceMatcher(None, flat(p), flat(q)).ratio() for p, q in zip(a, b, strict=True)])

    a = t.conversations.select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", ratio("text", "next").alias("ratio"))
