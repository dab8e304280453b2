"""Runs of words with their places: an index that finds where a text goes on as a source does, and texts that share runs.

A run stands for itself by two 64-bit hashes, made of 128-bit digests of its
words.  Hashes are computed for whole Arrow batches at once; what is found in a
source is compared word for word before it is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .store import settled

#: Words of a run, words that must be left behind it, words that are returned at most.
WIDTH, LEFT, MOST = 5, 8, 100
#: Hashes (16 bytes each) and found places that are sent to all tasks, at most; beyond that they are joined.
FEW = 1_000_000
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def run_hashes(texts: pa.Array, width: int, left: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, h1, h2) of every run of `width` words that has at least `left` words behind it in its text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    cut = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = cut.flatten()
    solid = pc.not_equal(flat, "")
    kept = np.concatenate([[0], np.cumsum(solid.to_numpy(zero_copy_only=False))])
    bounds = kept[np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))])]
    coded = flat.filter(solid).dictionary_encode()
    digests = b"".join([hashlib.blake2b(w.encode(), digest_size=16).digest() for w in coded.dictionary.to_pylist()])
    both = np.frombuffer(digests, "<u8").reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)]
    n = max(0, len(both) - width + 1)
    h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(width):
        h1 = _mixed(h1 * _FIRST + both[k : k + n, 0])
        h2 = _mixed(h2 * _SECOND + both[k : k + n, 1])
    sizes = np.maximum(np.diff(bounds) - width - left + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = bounds[:-1][text] + place
    return text, place, h1[at], h2[at]


def runs(rows: DataFrame, key: str, text: str | Column, width: int = WIDTH, left: int = 0, wanted: DataFrame | None = None) -> DataFrame:
    """(key, place, h1, h2) of the runs of each text; only those in `wanted` (h1, h2), if it is given and has at most `FEW` rows."""
    kind = rows.schema[key].dataType.simpleString()
    held = None
    if wanted is not None and wanted.count() <= FEW:
        found = wanted.toArrow()  # `FEW` rows at most
        pairs = np.stack([found.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")]) if found.num_rows else np.zeros((2, 0), np.uint64)
        held = rows.sparkSession.sparkContext.broadcast(pairs[:, np.lexsort((pairs[1], pairs[0]))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, h1, h2 = run_hashes(batch.column(1), width, left)
            if held is not None:
                a, b = held.value
                keep = np.flatnonzero(np.isin(h1, a) & np.isin(h2, b))  # a superset that is next to exact; the pair is joined later
                owner, place, h1, h2 = owner[keep], place[keep], h1[keep], h2[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=[key, "place", "h1", "h2"])

    return rows.select(key, (F.col(text) if isinstance(text, str) else text).alias("t")).mapInArrow(cut, f"`{key}` {kind}, place int, h1 long, h2 long")


def _small(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks if it is small."""
    return F.broadcast(df) if df.count() <= FEW // 10 else df


def echo(sources: DataFrame, key: str, text: str, recent: DataFrame, asked: str, said: str, width: int = WIDTH, left: int = LEFT, most: int = MOST) -> DataFrame:
    """Where the last words of each recent text stand in a source, and how the source goes on.

    recent (asked, said): texts of which the last `width` words are looked up.
    Returns asked, source (its key), position (in words, behind the run) and next
    (at most `most` words, at least `left`) of the first place, by key and
    position; recent texts without one are left out, as are those too short.
    The index is the first place of every run, so a run that stands everywhere is
    one row of it; runs that nobody asks for do not leave their task.
    """
    tail = F.array_join(F.slice(words(F.col(said), lower=False), -width, width), " ")
    long = F.size(words(F.col(said), lower=False)) >= width
    tails = settled(recent.where(long).select(asked, tail.alias("tail")))
    hashed = settled(runs(tails.select("tail").distinct(), "tail", "tail", width).select("tail", "h1", "h2"))
    pairs = hashed.select("h1", "h2").distinct()
    postings = runs(sources, key, text, width, left, pairs).join(_small(pairs), ["h1", "h2"], "left_semi")
    first = settled(postings.groupBy("h1", "h2").agg(F.min(F.struct(F.col(key).alias("source"), "place")).alias("at")).select("h1", "h2", "at.*"))
    goes_on = sources.select(F.col(key).alias("source"), F.col(text).alias("_text")).join(_small(first), "source")
    w = words(F.col("_text"), lower=False)
    goes_on = goes_on.withColumn("w", w).select("h1", "h2", "source", (F.col("place") + width).alias("position"), F.array_join(F.slice("w", F.col("place") + 1, F.lit(width)), " ").alias("run"), F.slice("w", F.col("place") + width + 1, F.lit(most)).alias("next"))
    met = tails.join(hashed, "tail").join(goes_on, ["h1", "h2"])
    return met.where("run = tail").select(asked, "source", "position", "next")


def shared_runs(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 8, width: int = WIDTH) -> DataFrame:
    """(key, item, shared): documents and items that share at least `least` distinct runs of words, in any case."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    of_items = settled(runs(items, item, low(item_text), width).select(item, "h1", "h2").distinct())
    pairs = of_items.select("h1", "h2").distinct()
    of_docs = runs(docs, key, low(text), width, 0, pairs).select(key, "h1", "h2").distinct()
    met = of_docs.join(_small(of_items), ["h1", "h2"])
    return met.groupBy(key, item).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def windows(rows: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, place, said): every run of `width` words of each text, as text."""
    w = words(F.col(text), lower=False)
    long = rows.select(key, w.alias("w")).where(F.size("w") >= width)
    return long.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("place")).select(key, "place", F.array_join(F.slice("w", F.col("place") + 1, F.lit(width)), " ").alias("said"))
