"""Operator 9: document quality by a linear-chain conditional random field over lines.

Every line of a text is a step of a chain, good or bad.  Features are shares of
character classes, length, words and repetitions of the line and of its
neighbours.  Forward-backward gives each line's probability of being good; the
document's score is their mean weighted by line length, calibrated on the
training documents so that a score means the share of label 1.

The model is fitted on a sample of labelled documents whose crc32(doc_id as
text) mod 4 is not 2: whole documents in order of their id's hash, at most
`sample` of them and as many as hold `most` bytes together (the next ones are
left out of the fit).  Scoring reads whole texts.  Labels, language, source and
id are not inputs of a score.

Defined cases: a null or empty text is one empty line; lines end at "\\n"; rows
that share an id are scored each, and the one of least text hash is fitted; labels that are null are not used, of several
labels of an id the largest counts; without any label every score is 0.5;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, keyed, table, text_pieces, trimmed
from .crf import Model, marginals, train

#: Documents and bytes that the model is fitted on at most, and the score from which a document is accepted.
SAMPLE, MOST, ACCEPT = 4000, 24 << 20, 0.7

#: Character classes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 stop, 6 mark, 7 bar, 8 part of a non-ASCII letter
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 5
_CLASS[[ord(c) for c in "#$%&*!@^~+=<>_/\\{}[]`"]] = 6
_CLASS[ord("|")] = 7
_CLASS[128:] = 8
OWN = 16
FEATURES = 3 * OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features, lengths in bytes, first line of each document) of the lines of a piece; every document has a line."""
    n = len(offsets) - 1
    ends = np.flatnonzero(data == 10) + 1
    # a line begins at a document's start and after each line end that is not the document's last byte
    starts = np.sort(np.concatenate([offsets[:-1], ends[~np.isin(ends, offsets)]]))
    doc = np.searchsorted(offsets, starts, "right") - 1
    empty = np.diff(offsets) == 0
    if empty.any():  # equal offsets: give each document its own line
        starts = np.concatenate([starts[~np.isin(starts, offsets)], offsets[:-1]])
        doc = np.concatenate([np.searchsorted(offsets, starts[: len(starts) - n], "right") - 1, np.arange(n)])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
    first = np.searchsorted(doc, np.arange(n + 1))
    total = len(starts)
    stop = np.append(starts[1:], len(data))
    size = stop - starts
    line = np.repeat(np.arange(total), size)
    counts = np.bincount(line * 9 + _CLASS[data], minlength=9 * total).reshape(total, 9).astype(float)
    words = Words(data, offsets)
    h = words.hashes()
    of = line[words.starts] if len(words.starts) else np.zeros(0, np.int64)
    n_words = np.bincount(of, minlength=total).astype(float)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[again], minlength=total)
    capital = np.bincount(of[(data[words.starts] >= 65) & (data[words.starts] < 91)], minlength=total) if len(h) else np.zeros(total)
    # how many different words, by sorting hashes within lines
    order = np.lexsort((h, of))
    kinds = np.bincount(of[order][np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])])] if len(h) else of, minlength=total)
    some, text = np.maximum(size, 1), np.maximum(n_words, 1)
    own = np.zeros((total, OWN), np.float32)
    own[:, :8] = counts[:, 1:] / some[:, None]
    own[:, 8] = np.minimum(np.log1p(size) / 8, 2)
    own[:, 9] = repeats / text
    own[:, 10] = kinds / text
    own[:, 11] = np.minimum(size / text / 12, 3)
    own[:, 12] = capital / text
    own[:, 13] = counts[:, 6] + counts[:, 7] > 0.5 * n_words
    own[:, 14] = counts[:, 2] > counts[:, 1]
    own[:, 15] = repeats * 2 > n_words
    return own, size, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The features of each line, of the line before and of the next one, within documents."""
    total = len(own)
    x = np.zeros((total, FEATURES), own.dtype)
    x[:, :OWN] = own
    head, tail = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    past, next_ = np.flatnonzero(~head[:-1]), np.flatnonzero(~tail[:-1])
    x[past, OWN : 2 * OWN] = own[past - 1]
    x[next_, 2 * OWN : 3 * OWN] = own[next_ + 1]
    x[:, -1] = 1
    return x


def _raw_scores(model: Model, own: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    p, _, _ = marginals(model, with_neighbours(own, first), first)
    weight = np.maximum(size, 1).astype(float)
    return np.add.reduceat(p[:, 1] * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST) -> tuple[Model, tuple[float, float]] | None:
    """The model and its calibration (slope, shift), or None without labels."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = {r[0]: int(r[1] > 0) for r in known.collect()}  # at most `sample` rows
    if not chosen:
        return None
    spark, rows = docs.sparkSession, keyed(docs)
    ids = spark.createDataFrame([(k,) for k in chosen], "_id long")
    # a row an id, in the sample's order, until the bytes are used up
    sizes = rows.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min(F.struct("_key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("row"))
    found = {r[0]: (r[1][0], r[1][1]) for r in sizes.collect()}
    picked, total = [], 0
    for k in chosen:
        if k in found and total + found[k][1] <= most:
            picked.append((k, found[k][0]))
            total += found[k][1]
    if not picked:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(2)):
                own, size, first = line_features(data, offsets)
                rows = [slice(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array([own[r].tobytes() for r in rows]), pa.array([size[r].astype(np.int64).tobytes() for r in rows])], names=["_id", "_key", "own", "size"])

    key = "_id long, _key long"
    got = rows.select("_id", "_key", "text").join(F.broadcast(spark.createDataFrame(picked, key)), ["_id", "_key"])
    got = {r._id: (r.own, r.size) for r in got.mapInArrow(lambda x: trimmed(run(x)), f"{key}, own binary, size binary").dropDuplicates(["_id"]).collect()}  # `most` bytes of text
    ids = sorted(got)
    xs = [np.frombuffer(got[k][0], np.float32).reshape(-1, OWN) for k in ids]
    size = np.concatenate([np.frombuffer(got[k][1], np.int64) for k in ids])
    first = np.concatenate([[0], np.cumsum([len(a) for a in xs])])
    own, x = np.concatenate(xs), with_neighbours(np.concatenate(xs), first)
    good = np.array([chosen[k] for k in ids])
    model = train(x, first, np.repeat(good, np.diff(first)), 2)
    # calibration: a logistic curve over the raw score, by Newton steps
    z, slope, shift = _logit(_raw_scores(model, own, size, first)), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((good - p) * z).sum() - 0.01 * slope, (good - p).sum() - 0.01 * shift])
        hess = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope + np.clip(step[0], -1, 1), shift + np.clip(step[1], -1, 1)
    return model, (float(max(slope, 1e-3)), float(shift))


def score(docs: DataFrame, fitted: tuple[Model, tuple[float, float]] | None, *keep: str) -> DataFrame:
    """docs' `keep` columns with score, from 0 to 1."""
    fields = [f for f in docs.select(*keep).schema.fields]
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema
    if fitted is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    model, (slope, shift) = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(len(fields))):
                z = _logit(_raw_scores(model, *line_features(data, offsets)))
                p = 1 / (1 + np.exp(-(slope * z + shift)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(fields))), pa.array(p)], names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(lambda x: trimmed(run(x)), schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), "doc_id")
    return out.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
