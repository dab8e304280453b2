"""Vector operators: aggregation over peers, clipping, cosine and Hamming similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """A row per coordinate: keys, pos, x."""
    return rows.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))


def fedavg(rows: DataFrame, group: str, vector: str, weight: str) -> DataFrame:
    """The weighted mean of each coordinate; without any weight the plain mean."""
    g = long_form(rows, [group, weight], vector).groupBy(group, "pos").agg(F.sum(F.col("x") * F.col(weight)).alias("wx"), F.sum(weight).alias("w"), F.avg("x").alias("mean"))
    return g.select(group, "pos", F.when(F.col("w") == 0, F.col("mean")).otherwise(F.col("wx") / F.nullif("w", F.lit(0))).alias("x"))


def coordinate_median(rows: DataFrame, group: str, vector: str) -> DataFrame:
    return long_form(rows, [group], vector).groupBy(group, "pos").agg(F.median("x").alias("x"))


def trimmed_mean(rows: DataFrame, group: str, vector: str, share: float = 0.1) -> DataFrame:
    """The mean without max(1, share) values at each end; the median where too few are left."""
    by = Window.partitionBy(group, "pos")
    r = long_form(rows, [group], vector).withColumn("n", F.count("*").over(by)).withColumn("k", F.row_number().over(by.orderBy("x")))
    r = r.withColumn("trim", F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    inner = F.when((F.col("k") > F.col("trim")) & (F.col("k") <= F.col("n") - F.col("trim")), F.col("x"))
    return r.groupBy(group, "pos").agg(F.when(F.max("n") <= 2 * F.max("trim"), F.median("x")).otherwise(F.avg(inner)).alias("x"))


def divergence(rows: DataFrame, aggregate: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """The mean distance of a group's vectors to its aggregate (group, pos, x); 0 for one peer."""
    r = long_form(rows, [group, key], vector).join(aggregate.withColumnRenamed("x", "center"), [group, "pos"])
    d = r.groupBy(group, key).agg(F.sqrt(F.sum((F.col("x") - F.col("center")) ** 2)).alias("d"))
    return d.groupBy(group).agg(F.when(F.count("*") <= 1, F.lit(0.0)).otherwise(F.avg("d")).alias("divergence"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def clip_l2(a: Column, most: float) -> Column:
    """The vector scaled down to a norm of at most `most`."""
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x * F.least(F.lit(1.0), F.lit(most) / F.greatest(n, F.lit(1e-12))))


def gaussian_sigma(clip: float, epsilon: float, delta: float) -> float:
    return clip * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def laplace_scale(clip: float, epsilon: float) -> float:
    return clip / epsilon


def noised(a: Column, clip: float, epsilon: float, delta: float, seed: Column, gaussian: bool = True) -> Column:
    """The vector with noise drawn from hashes of seed and place: the same rows give the same noise."""

    def uniform(i: Column, salt: int) -> Column:
        return (F.pmod(F.xxhash64(seed, i, F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def draw(i: Column) -> Column:
        if gaussian:
            return F.sqrt(-2 * F.ln(uniform(i, 1))) * F.cos(2 * math.pi * uniform(i, 2)) * gaussian_sigma(clip, epsilon, delta)
        u = uniform(i, 1) - 0.5
        return -F.signum(u) * F.ln(1 - 2 * F.abs(u)) * laplace_scale(clip, epsilon)

    return F.transform(clip_l2(a, clip), lambda x, i: x + draw(i))


def sign_bits(a: Column, words: int) -> Column:
    """A vector's signs packed 32 to a word."""
    word = lambda k: F.aggregate(F.transform(F.slice(a, 32 * k + 1, 32), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.array(*[word(k) for k in range(words)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: Bits of a hypervector, and the seed of its codebook.
DIMENSIONS, CODEBOOK = 10_000, 42
#: Vectors of words that a task remembers (each of two bytes a bit).
REMEMBER = 2000


def hypervectors(rows: DataFrame, keys: list[str], text: str, dim: int = DIMENSIONS, seed: int = CODEBOOK) -> DataFrame:
    """keys and `bits`: binary hypervectors of whole texts, packed.

    Letters come from a seeded codebook and are rotated by their place in the
    word; words are rotated by their place in the text; the majority of the
    words sets a bit.  The vectors of some words are remembered, the others built anew.
    """
    book = np.random.RandomState(seed).randint(0, 2, (256, dim)).astype(np.uint8)
    schema = rows.select(*keys, F.lit(b"").alias("bits")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.concatenate([book, book], axis=1)
        for batch in batches:
            known: dict[str, np.ndarray] = {}
            out = []
            for value in batch.column(len(keys)).to_pylist():
                total, words = np.zeros(dim, np.int32), (value or "").lower().split()
                for i, word in enumerate(words):
                    if word not in known:
                        if len(known) >= REMEMBER:
                            known.clear()
                        v = np.zeros(dim, np.uint8)
                        for j, c in enumerate(word.encode()):
                            v ^= twice[c, dim - j % dim : 2 * dim - j % dim]
                        known[word] = np.concatenate([v, v])
                    total += known[word][dim - i % dim : 2 * dim - i % dim]
                out.append(np.packbits(total * 2 > len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(out, pa.binary())], names=[*keys, "bits"])

    return rows.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)
