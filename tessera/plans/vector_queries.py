"""Queries over embeddings: a label is a round, a vector a peer's update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nearest
from ..operators import vectors as v
from .registry import Tables, query

_LONG = "l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS pos FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({}.embedding, lambda p: p::DOUBLE * p::DOUBLE)))"


def updates(t: Tables) -> DataFrame:
    return t.embeddings.withColumn("w", (F.col("vec_id") % 5).cast("double"))


@query("s10_scan_vectors", "SELECT vec_id, label, len(embedding)::INT AS dim FROM embeddings")
def scan_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.size("embedding").alias("dim"))


@query("a17_fedavg", f"WITH {_LONG} SELECT label, pos, round(sum(x * (vec_id % 5)) / sum(vec_id % 5), 6) AS x FROM l GROUP BY label, pos")
def fedavg(t: Tables) -> DataFrame:
    return v.fedavg(updates(t), "label", "embedding", "w").withColumn("x", F.round("x", 6))


@query("a18_coord_median", f"WITH {_LONG} SELECT label, pos, round(median(x), 6) AS x FROM l GROUP BY label, pos")
def coord_median(t: Tables) -> DataFrame:
    return v.coordinate_median(updates(t), "label", "embedding").withColumn("x", F.round("x", 6))


_TRIM = f"{_LONG}, r AS (SELECT *, count(*) OVER (PARTITION BY label, pos) AS n, row_number() OVER (PARTITION BY label, pos ORDER BY x) AS k FROM l)"


@query("a19_trimmed_mean", f"WITH {_TRIM} SELECT label, pos, round(avg(x), 6) AS x FROM r WHERE k > greatest(1, floor(n * 0.1)) AND k <= n - greatest(1, floor(n * 0.1)) GROUP BY label, pos")
def trimmed_mean(t: Tables) -> DataFrame:
    return v.trimmed_mean(updates(t), "label", "embedding").withColumn("x", F.round("x", 6))


@query("a20_divergence", f"WITH {_LONG}, m AS (SELECT label, pos, avg(x) AS c FROM l GROUP BY ALL), d AS (SELECT label, vec_id, sqrt(sum((x - c) ** 2)) AS d FROM l JOIN m USING (label, pos) GROUP BY ALL) SELECT label, round(avg(d), 6) AS divergence FROM d GROUP BY label")
def divergence(t: Tables) -> DataFrame:
    u = updates(t)
    center = v.long_form(u, ["label"], "embedding").groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return v.divergence(u, center, "label", "vec_id", "embedding").withColumn("divergence", F.round("divergence", 6))


@query("a28_privacy_accounting", "SELECT label, count(*) * 0.5 AS epsilon_spent, round(avg(sqrt(list_sum(list_transform(embedding, lambda p: p::DOUBLE * p::DOUBLE)))), 6) AS mean_norm FROM embeddings GROUP BY label")
def privacy_accounting(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg((F.count("*") * F.lit(0.5).cast("double")).alias("epsilon_spent"), F.round(F.avg(v.norm(F.col("embedding"))), 6).alias("mean_norm"))


@query("t5_cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(t: Tables) -> DataFrame:
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(v.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("t44_clip_l2", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda p: (p::DOUBLE * least(1.0, 0.5 / sqrt(list_sum(list_transform(embedding, lambda q: q::DOUBLE * q::DOUBLE))))) ** 2))), 6) AS norm FROM embeddings")
def clip_l2(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(v.norm(v.clip_l2(F.col("embedding"), 0.5)), 6).alias("norm"))


@query("t45_dp_noise")
def dp_noise(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", v.noised(F.col("embedding"), 1.0, 1.0, 1e-5, F.col("vec_id")).alias("noised"))


@query("l11_vector_topk", f"SELECT b.vec_id, round(1 - {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 AND 1 - {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) < 0.8 ORDER BY 2, 1 LIMIT 20")
def vector_topk(t: Tables) -> DataFrame:
    """Exact nearest vectors of one query vector, which is a row (a broadcast of bounded size)."""
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    d = 1 - v.cosine(F.col("q"), F.col("embedding"))
    hit = t.embeddings.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", d.alias("d")).where("d < 0.8")
    return hit.select("vec_id", F.round("d", 5).alias("distance")).orderBy("distance", "vec_id").limit(20)


_BITS = "b AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding[1:32], range(0, 32)), lambda p: CASE WHEN p[1] > 0 THEN (1::BIGINT << p[2]::INT) ELSE 0 END))::BIGINT AS w1, list_sum(list_transform(list_zip(embedding[33:64], range(0, 32)), lambda p: CASE WHEN p[1] > 0 THEN (1::BIGINT << p[2]::INT) ELSE 0 END))::BIGINT AS w2 FROM embeddings)"


@query("t8_hamming", f"WITH {_BITS} SELECT x.vec_id, bit_count(xor(x.w1, y.w1)) + bit_count(xor(x.w2, y.w2)) AS distance, 1 - (bit_count(xor(x.w1, y.w1)) + bit_count(xor(x.w2, y.w2))) / 64 AS similarity FROM b x JOIN b y ON y.vec_id = x.vec_id + 1")
def hamming(t: Tables) -> DataFrame:
    b = t.embeddings.select("vec_id", v.sign_bits(F.col("embedding"), 2).alias("bits"))
    other = b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("other"))
    return b.join(other, "vec_id").select("vec_id", v.hamming(F.col("bits"), F.col("other")).alias("distance")).withColumn("similarity", 1 - F.col("distance") / 64)


@query("l12_hamming_topk", f"WITH {_BITS} SELECT x.vec_id, bit_count(xor(x.w1, y.w1)) + bit_count(xor(x.w2, y.w2)) AS distance FROM b x, b y WHERE y.vec_id = 3 AND x.vec_id <> 3 ORDER BY 2, 1 LIMIT 10")
def hamming_topk(t: Tables) -> DataFrame:
    b = t.embeddings.select("vec_id", v.sign_bits(F.col("embedding"), 2).alias("bits"))
    q = b.where("vec_id = 3").select(F.col("bits").alias("q")).limit(1)
    return b.where("vec_id <> 3").crossJoin(F.broadcast(q)).select("vec_id", v.hamming(F.col("bits"), F.col("q")).alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("m19_federated_round", f"WITH {_LONG}, g AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 3) SELECT label, count(DISTINCT vec_id) AS peers, round(avg(x), 6) AS mean FROM l WHERE label IN (SELECT label FROM g) GROUP BY label")
def federated_round(t: Tables) -> DataFrame:
    """Rounds with enough peers only."""
    enough = t.embeddings.groupBy("label").count().where("count >= 3").select("label")
    u = t.embeddings.join(enough, "label", "left_semi")
    return v.long_form(u, ["label", "vec_id"], "embedding").groupBy("label").agg(F.count_distinct("vec_id").alias("peers"), F.round(F.avg("x"), 6).alias("mean"))


@query("t47_semantic_draft", f"WITH s AS (SELECT a.vec_id AS asked, b.vec_id AS kept, {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0), r AS (SELECT asked, arg_min(kept, (-round(c, 12), kept)) AS kept, max(c) AS c FROM s GROUP BY asked) SELECT asked, kept, round(c, 6) AS cosine FROM r WHERE c >= 0.3 AND c < 0.95")
def semantic_draft(t: Tables) -> DataFrame:
    """Every third vector asks the others: an answer to start from if the nearest is alike, but not the same."""
    asks = F.col("vec_id") % 3 == 0
    found = nearest.drafts(t.embeddings.where(asks), t.embeddings.where(~asks), "vec_id", "embedding", 0.3, 0.95)
    return found.select("asked", "kept", F.round("cosine", 6).alias("cosine"))
