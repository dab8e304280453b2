"""Operator 4: document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs: runs of words up to a line's or sentence's end,
`WORDS` words at most.  Each paragraph's digest (with the number of its
occurrence, so repeats count) is added to a count, a key sum and a check sum in
three cells.  Sketches of two texts subtract; peeling cells that hold one digest
recovers the digests in which the texts differ.  If peeling stops early, both
are sketched again with four times the cells and another seed.

The fingerprint is the smallest sketch.  Likeness is the share of paragraphs
in common, 1 - d / (a + b) for d recovered digests and a and b paragraphs.

Defined cases: null is an empty text; an empty text has no paragraphs, and two
of those are alike (1); null ids come last and rows that share an id follow each
other by the hash of their text; in a table of one row it is its own next;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, _mix, keyed, materialize, range_hashes, table, text_pieces, trimmed

CELLS, GROW, WORDS = 24, 4, 8
#: Bytes of text in a range of ids, about, and rows that the borders of ranges are taken from, at least.
RANGE, SAMPLE = 128 << 20, 20_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph digests, first of each document) of a piece of texts."""
    w = Words(data, offsets)
    total = len(w.starts)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ends_line = np.zeros(total, bool)
    after = data[np.minimum(w.ends, len(data) - 1)]
    last = data[w.ends - 1]
    ends_line |= (after == 10) | (last == 46) | (last == 33) | (last == 63)
    begin = np.zeros(total, bool)
    begin[1:] = ends_line[:-1]
    begin[w.first[:-1][w.first[:-1] < total]] = True
    head = np.maximum.accumulate(np.where(begin, np.arange(total), 0))
    begin |= (np.arange(total) - head) % WORDS == 0
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, total))
    key = range_hashes(w.hashes(), at, size)
    first = np.searchsorted(at, w.first)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((key, doc))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    run = np.arange(len(key))
    nth = np.zeros(len(key), np.uint64)
    nth[order] = (run - np.maximum.accumulate(np.where(same, 0, run))).astype(np.uint64)
    return _mix(key + nth * _SEED), first


def _cells(keys: np.ndarray, cells: int, level: int) -> np.ndarray:
    """The three cells of each key: one in each third."""
    third = cells // 3
    return np.stack([(_mix(keys + np.uint64((3 * level + j + 1) * int(_SEED) % (1 << 64))) % np.uint64(third)).astype(np.int64) + j * third for j in range(3)])


def sketch(keys: np.ndarray, owner: np.ndarray, owners: int, cells: int, level: int, sign: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, key sums and check sums (owners x cells, flat)."""
    count, total, check = np.zeros(owners * cells, np.int64), np.zeros(owners * cells, np.uint64), np.zeros(owners * cells, np.uint64)
    sign = np.ones(len(keys), np.int64) if sign is None else sign
    factor, mixed = sign.astype(np.uint64), _mix(keys ^ _SEED)
    for at in _cells(keys, cells, level) + owner * cells:
        np.add.at(count, at, sign)
        np.add.at(total, at, keys * factor)
        np.add.at(check, at, mixed * factor)
    return count, total, check


def differences(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> np.ndarray:
    """How many digests differ, for each pair of documents, recovered from subtracted sketches."""
    pairs = len(a_first) - 1
    out, level, cells = np.zeros(pairs, np.int64), 0, CELLS
    a_of, b_of = np.repeat(np.arange(pairs), np.diff(a_first)), np.repeat(np.arange(pairs), np.diff(b_first))
    open_ = np.arange(pairs)
    while len(open_):
        number = np.full(pairs, -1)
        number[open_] = np.arange(len(open_))
        ka, kb = number[a_of] >= 0, number[b_of] >= 0
        keys = np.concatenate([a[ka], b[kb]])
        owner = np.concatenate([number[a_of[ka]], number[b_of[kb]]])
        sign = np.concatenate([np.ones(int(ka.sum()), np.int64), -np.ones(int(kb.sum()), np.int64)])
        count, total, check = sketch(keys, owner, len(open_), cells, level, sign)
        found = np.zeros(len(open_), np.int64)
        look = np.flatnonzero(count)
        while len(look):
            pure = look[np.abs(count[look]) == 1]
            s = count[pure]
            key = total[pure] * s.astype(np.uint64)
            good = check[pure] * s.astype(np.uint64) == _mix(key ^ _SEED)
            pure, s, key = pure[good], s[good], key[good]
            if not len(pure):
                break
            of = pure // cells
            _, one = np.unique(np.stack([of.astype(np.uint64), key]), axis=1, return_index=True)
            of, s, key = of[one], s[one], key[one]
            np.add.at(found, of, 1)
            factor, mixed = s.astype(np.uint64), _mix(key ^ _SEED)
            touched = _cells(key, cells, level) + of * cells
            for at in touched:
                np.subtract.at(count, at, s)
                np.subtract.at(total, at, key * factor)
                np.subtract.at(check, at, mixed * factor)
            look = np.unique(touched)
            look = look[count[look] != 0]
        left = (count.reshape(-1, cells) != 0).any(1) | (total.reshape(-1, cells) != 0).any(1) | (check.reshape(-1, cells) != 0).any(1)
        out[open_[~left]] = found[~left]
        open_, level, cells = open_[left], level + 1, cells * GROW
    return out


def likeness(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> np.ndarray:
    size = np.diff(a_first) + np.diff(b_first)
    return np.where(size == 0, 1.0, 1 - differences(a, a_first, b, b_first) / np.maximum(size, 1))


def prints(keys: np.ndarray, first: np.ndarray) -> list[str]:
    """Fingerprints as text: the number of paragraphs and the smallest sketch."""
    n = len(first) - 1
    count, total, check = sketch(keys, np.repeat(np.arange(n), np.diff(first)), n, CELLS, 0)
    rows = np.concatenate([count.reshape(n, CELLS).astype("<i4").view(np.uint8), total.reshape(n, CELLS).astype("<u8").view(np.uint8), check.reshape(n, CELLS).astype("<u4").view(np.uint8)], axis=1)
    return [f"{k}:{base64.b64encode(r.tobytes()).decode()}" for k, r in zip(np.diff(first).tolist(), rows, strict=True)]


def _all_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    keys, first, at = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in text_pieces(pa.array(texts, pa.large_string())):
        k, f = digests(data, offsets)
        keys.append(k)
        first.append(f[1:] + at)
        at += len(k)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(first)


def _take(keys: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)[pick]
    ends = np.cumsum(size)
    return keys[np.repeat(first[pick], size) + np.arange(int(size.sum())) - np.repeat(ends - size, size)], np.concatenate([[0], ends])


def _range_of(docs: DataFrame, parts: int) -> Callable[[Column, Column], Column]:
    """The number of a row's range of (_id, _key), of `parts` at most.

    The borders are taken from a sample of some rows a range, picked by their
    hashes; a hot id is cut by the hashes of its texts.  Tasks look borders up
    in a sorted array of 16 bytes a range.
    """
    wanted = max(SAMPLE, 4 * parts)
    share = int(min(1.0, wanted / max(1, docs.count())) * (1 << 40))
    seen = docs.select("_id", "_key").where(F.pmod(F.xxhash64(F.lit(5), "_id", "_key"), F.lit(1 << 40)) < share).toArrow()
    pairs = np.empty(seen.num_rows, [("i", "<i8"), ("k", "<i8")])
    pairs["i"], pairs["k"] = (seen.column(c).to_numpy() for c in ("_id", "_key"))
    pairs.sort(order=["i", "k"])
    cuts = docs.sparkSession.sparkContext.broadcast(np.unique(pairs[[len(pairs) * i // parts for i in range(1, parts)]]) if len(pairs) else pairs)

    @F.pandas_udf("int")
    def number(ids: pd.Series, keys: pd.Series) -> pd.Series:
        asked = np.empty(len(ids), cuts.value.dtype)
        asked["i"], asked["k"] = ids.to_numpy(), keys.to_numpy()
        return pd.Series(np.searchsorted(cuts.value, asked, "left").astype(np.int32))

    return number


def following(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of `common.keyed` dealt to ranges of ids, each range sorted and closed by a copy (`tail`) of the row after it.

    So a row's next document comes right after it, and every text is shuffled once.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    rows = docs.withColumn("_bucket", _range_of(docs, parts)(F.col("_id"), F.col("_key")))
    firsts = rows.groupBy("_bucket").agg(F.min(F.struct("_id", "_key")).alias("head"))  # a row a range
    around = Window.orderBy("_bucket")
    before = F.coalesce(F.lag("_bucket").over(around), F.last("_bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = materialize(firsts.select(before.alias("_to"), "head._id", "head._key"), "heads")
    rows = rows.join(F.broadcast(heads), ["_id", "_key"], "left")  # 24 bytes for `RANGE` bytes of text
    own = F.struct(F.col("_bucket").alias("to"), F.lit(0).alias("tail"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("to"), F.lit(1).alias("tail"))))))
    return rows.select("doc_id", "_id", "_key", F.coalesce("text", F.lit("")).alias("text"), F.col("_at.to").alias("_bucket"), F.col("_at.tail").alias("tail")).repartitionById(parts, F.col("_bucket")).sortWithinPartitions("_bucket", "tail", "_id", "_key")


def fingerprint_versions(docs: DataFrame, group: int = 256) -> DataFrame:
    """Per document: its text's fingerprint, that of the text edited with the next document, and likenesses."""

    def emit(rows: list[tuple]) -> pa.RecordBatch | None:
        """Rows that have their next row behind them."""
        live = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        if not live:
            return None
        texts = [r[1] for r in rows]
        edited = []
        for i in live:
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
        keys, first = _all_digests(texts)
        e_keys, e_first = _all_digests(edited)
        pick = np.array(live)
        mine, next_ = _take(keys, first, pick), _take(keys, first, pick + 1)
        columns = [
            pa.array([rows[i][0] for i in live], pa.int64()),
            pa.array([len(texts[i]) for i in live], pa.int64()),
            pa.array(prints(*mine)),
            pa.array(prints(e_keys, e_first)),
            pa.array(likeness(*mine, e_keys, e_first)),
            pa.array(likeness(*mine, *next_)),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, group):
                held += zip(*(c.to_pylist() for c in batch.slice(lo, group).columns), strict=True)
                out = emit(held)
                held = held[-1:]
                if out is not None:
                    yield out

    schema = "doc_id long, n_chars long, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_sha256 string"
    return following(keyed(docs)).select(F.col("doc_id").cast("long"), "text", "_bucket", "tail").mapInArrow(lambda x: trimmed(run(x)), schema)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))
