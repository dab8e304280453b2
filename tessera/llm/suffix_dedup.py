"""Operator 2: repeated byte strings, by suffix arrays over shards.

Equal strings of `length` bytes lie in blocks of one anchor fingerprint (see
`common.blocks`), so blocks are dealt to shards by fingerprint and no match
crosses shards.  Blocks of equal content, told by a 128-bit digest, are one:
copies are counted before, so that a hot group is one row.  Each shard holds
one representative per content of the fingerprints that have several, as
suffix-array text, but for those that cannot share a window with another (see
`partnered`).  The shard's suffixes are sorted by induced sorting, their common
prefixes are computed in text order, and every window start whose suffix
shares `length` bytes with a neighbour in the order is repeated.

A fingerprint whose different contents alone exceed a shard has no bounded
suffix array; the exact way for those is to group digests of their windows,
which splits over any number of tasks.

Defined cases: null is an empty text; a text shorter than `length` loses
nothing; equal rows are copies of each other and lose all they share (also
where they share a doc_id); extra columns are ignored.  A kernel holds one text
at a time, at about 60 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, byte_values, digests, keyed, materialize, table, text_pieces, trimmed, window_hashes
from .suffix_array import permuted_prefixes, suffix_array

LENGTH, GRAM, SHARD_BYTES = 400, 32, 3 << 20

#: A block's fingerprint and the digest of its bytes.
KEY = ("fp", "c1", "c2")
_SPANS = "array<struct<lo:int,hi:int>>"


def _postings(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, data, offsets in text_pieces(batch.column(2)):
                b = blocks(byte_values(data), offsets, length, gram)
                c1, c2 = digests(data, b["at"], b["at"] + b["n"] + length - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[lo:hi][b["doc"]], keys[lo:hi][b["doc"]], b["fp"], c1, c2, b["start"].astype(np.int32), b["n"].astype(np.int32))], names=["_id", "_key", "fp", "c1", "c2", "start", "n"])

    return docs.select("_id", "_key", "text").mapInArrow(lambda x: trimmed(run(x)), "_id long, _key long, fp long, c1 long, c2 long, start int, n int")


def _bodies(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted blocks, read from the texts; hashes of windows instead where the block's fingerprint is wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at, values = lists.offsets.to_numpy(), lists.values
            fields = dict(zip((*KEY, "start", "n", "single", "shard"), values.flatten(), strict=True))
            start, n = (fields[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n"))
            shard = fields["shard"].to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_pieces(batch.column(0)):
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                own = np.arange(at[lo], at[hi])
                head = offsets[doc] + start[own]
                whole = shard[own] >= 0
                size = np.where(whole, n[own] + length - 1, 0)
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                body = data[np.repeat(head, size) + step]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                bodies = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(body)])
                hashes = [[], []]
                count = np.where(whole, 0, n[own])
                if count.any():
                    block = np.repeat(np.arange(len(own)), count)
                    place = head[block] + np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
                    hashes = digests(data, place, place + length)
                cut = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                windows = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int64())) for x in hashes]
                pick = pa.array(own)
                yield pa.RecordBatch.from_arrays([*(fields[k].take(pick) for k in ("shard", *KEY, "n", "single")), bodies, *windows], names=["shard", *KEY, "n", "single", "body", "w1", "w2"])

    lists = wanted.groupBy("_id", "_key").agg(F.collect_list(F.struct(*KEY, "start", "n", "single", "shard")).alias("blocks"))
    return docs.select("_id", "_key", "text").join(lists, ["_id", "_key"]).select("text", "blocks").mapInArrow(lambda x: trimmed(run(x)), "shard long, fp long, c1 long, c2 long, n int, single boolean, body binary, w1 array<long>, w2 array<long>")


def _ranges(hit: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that stay within one value of `of`."""
    edge = np.concatenate([[True], of[1:] != of[:-1]])
    return np.flatnonzero(hit & (edge | np.concatenate([[True], ~hit[:-1]]))), np.flatnonzero(hit & np.concatenate([edge[1:] | ~hit[1:], [True]])) + 1


def partnered(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, fp: np.ndarray, single: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Bodies that may share a window with another one of their fingerprint, where one of the two is single.

    Equal windows have their anchor at one place.  Each holds the piece of
    `length - step + 1` bytes that begins at the window's first place a multiple
    of `step` before the anchor.  So a body none of whose such pieces occurs in
    another one shares no window, and no repeat is lost without it.
    """
    step = max(1, length // 8)
    piece = length - step + 1
    values = byte_values(data)
    grams = window_hashes(values, gram).view(np.int64)
    # the anchor is the first of its hash in what all windows of a block hold
    core = length - gram - starts + 2
    body = np.repeat(np.arange(len(starts)), core)
    place = np.arange(len(body)) + np.repeat(offsets[:-1] + starts - 1 - (np.cumsum(core) - core), core)
    hit = np.flatnonzero(grams[place] == fp[body])
    body, first = np.unique(body[hit], return_index=True)
    at = place[hit[first]][:, None] - step * np.arange((length - gram) // step + 1)
    row, k = np.nonzero((at >= offsets[body, None]) & (at + piece <= offsets[body + 1, None]))
    body, at = body[row], at[row, k]
    _, group, times = np.unique(window_hashes(values, piece)[at] ^ fp[body].view(np.uint64), return_inverse=True, return_counts=True)
    out = np.zeros(len(starts), bool)
    out[body[((times > 1) & (np.bincount(group, single[body], len(times)) > 0))[group]]] = True
    return np.flatnonzero(out)


def shard_repeats(bodies: list[bytes], starts: list[int], length: int) -> list[tuple[int, int, int]]:
    """(body, first, end) of window starts whose `length` bytes occur more than once in the bodies."""
    if not bodies:
        return []
    raw = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)  # 0xff is in no UTF-8 text
    order = suffix_array(np.append(raw.astype(np.int16) + 1, np.int16(0)), 257)
    shared = permuted_prefixes(raw, order)
    order = order[order < len(raw)]
    hit = shared >= length
    hit[order[:-1]] |= shared[order[1:]] >= length
    sizes = np.array([len(x) for x in bodies]) + 1
    head = np.cumsum(sizes) - sizes
    body = np.repeat(np.arange(len(bodies)), sizes)
    place = np.arange(len(raw)) - head[body]
    hit &= place < np.array(starts)[body]
    lo, hi = _ranges(hit, body)
    return list(zip(body[lo].tolist(), place[lo].tolist(), (hi - head[body[lo]]).tolist(), strict=True))


def _by_suffixes(bodies: DataFrame, length: int, gram: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        texts = group.column("body").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        n, fp, single = (group.column(k).to_numpy() for k in ("n", "fp", "single"))
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        group = group.take(pa.array(partnered(data, offsets - offsets[0], n.astype(np.int64), fp, single, length, gram)))
        single = group.column("single").to_pylist()
        found: dict[int, list[dict[str, int]]] = {}
        for body, lo, hi in shard_repeats(group.column("body").to_pylist(), group.column("n").to_pylist(), length):
            if single[body]:
                found.setdefault(body, []).append({"lo": lo, "hi": hi})
        spans = pa.array(list(found.values()), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
        keys = group.select(KEY).take(pa.array(list(found), pa.int64()))
        return keys.append_column("spans", spans)

    return bodies.select("shard", *KEY, "n", "single", "body").groupBy("shard").applyInArrow(run, f"fp long, c1 long, c2 long, spans {_SPANS}")


def _cut(docs: DataFrame, removed: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            first, last = (x.to_numpy(zero_copy_only=False) for x in lists.values.flatten())
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                own = slice(at[lo], at[hi])
                base = offsets[:-1][np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))]
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, base + first[own], 1)
                np.add.at(edge, base + last[own] - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                sizes = np.diff(offsets)
                doc = np.repeat(np.arange(hi - lo), sizes)
                head, tail = _ranges(gone, doc) if len(data) else (np.zeros(0, np.int64),) * 2
                whose = doc[head] if len(data) else head
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(hi - lo + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(head - offsets[whose]), pa.array(tail - offsets[whose])], names=["start", "end"]))
                lost = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])[offsets]
                kept = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((offsets - lost).astype(np.int32)), pa.py_buffer(data[~gone])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(np.diff(lost)), kept, spans], names=["doc_id", "n_bytes", "n_removed", "kept", "removed"])

    lists = removed.groupBy("_id", "_key").agg(F.flatten(F.collect_list("spans")).alias("cuts"))
    rows = docs.join(lists, ["_id", "_key"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("cuts", F.expr(f"cast(array() as {_SPANS})")).alias("cuts"))
    return rows.mapInArrow(lambda x: trimmed(run(x)), "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts elsewhere.

    docs has doc_id and text.  Returns doc_id, n_bytes, n_removed, kept (the
    remaining bytes) and removed (maximal byte ranges).
    """
    if not 0 < gram <= length:
        raise ValueError("0 < gram <= length")
    rows = keyed(docs)
    postings = materialize(_postings(rows, length, gram), "postings")
    tally = materialize(postings.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min(F.struct("_id", "_key", "start", "n")).alias("rep")), "tally")
    # fingerprints with several contents, one of which is not known to repeat
    several = tally.groupBy("fp").agg(F.count("*").alias("kinds"), F.min("copies").alias("least"), F.sum(F.col("rep.n") + length).alias("size")).where("kinds > 1 AND least = 1").select("fp", "size")
    several = materialize(several, "several")
    total = several.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // (shard_bytes // 2)))
    wanted = tally.join(several, "fp").select(*KEY, "rep.*", F.expr("copies = 1").alias("single"), F.when(F.col("size") <= shard_bytes, F.pmod(F.xxhash64("fp"), F.lit(shards))).otherwise(F.lit(-1)).alias("shard"))
    bodies = materialize(_bodies(rows, wanted, length), "bodies")
    sorted_ = _by_suffixes(bodies.where("shard >= 0"), length, gram)
    windows = bodies.where("shard < 0").select(*KEY, "single", F.posexplode(F.arrays_zip("w1", "w2")).alias("off", "w")).select(*KEY, "single", "off", "w.*")
    twice = windows.groupBy("fp", "w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("fp", "w1", "w2")
    grouped = windows.where("single").join(twice, ["fp", "w1", "w2"], "left_semi").groupBy(*KEY).agg(F.collect_list(F.struct(F.col("off").alias("lo"), (F.col("off") + 1).alias("hi"))).alias("spans"))
    verdict = tally.where("copies > 1").select(*KEY, F.lit(None).cast(_SPANS).alias("spans")).unionByName(sorted_).unionByName(grouped)
    removed = postings.join(verdict, list(KEY)).select("_id", "_key", F.expr("coalesce(transform(spans, s -> struct(start + s.lo AS lo, start + s.hi AS hi)), array(struct(start AS lo, start + n AS hi)))").alias("spans"))
    return _cut(rows, removed, length)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same by plain SQL: a digest of every string of 400 bytes, as hexadecimal text.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 399)) AS i, unnest(list_transform(range(0, n - 399), lambda i: md5(substring(h, 2 * i + 1, 800)))) AS k FROM d WHERE n >= 400),
m AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM m)),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
p AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, g),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM p),
x AS (SELECT doc_id, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept, sum(b - a)::BIGINT AS gone, count(*) AS spans, max(b) AS z FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""
