"""Operator 6: best-fit packing of token sequences by hierarchical residual packing.

Each partition tokenizes its texts, cuts documents longer than the capacity
into pieces, and packs its pieces best-fit in falling order.  Bins that are
nearly full are final.  The underfull ones move up a tree of partitions as
items, `fan` children to a node, and each node packs them best-fit again.  A
piece's place follows by adding up the offsets on its way.

A node that has more than `most` bins is dealt into several of that size, each
packed best-fit on its own; their underfull bins go on up as those of one node.
That bounds a task's memory and leaves no bin out of a round.

Words (runs without ASCII white space) are tokenized apart and looked up in a
table of words seen before: the tokenizer drops white space and never joins
across it, so the ids are those of the whole text.  Words of ASCII and Latin-1
letters are cut by the tokenizer's own pattern first, whole pieces at a time.

Defined cases: null is an empty text, whose only id is the end mark; rows that
share an id are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, materialize, table, text_pieces, trimmed

CAPACITY, END, FAN, MOST, NEARLY = 4096, 1, 8, 100_000, 0.999
#: Pieces that a partition packs at once (their underfull bins meet in the tree), and words whose ids are remembered.
BLOCK, REMEMBER = 100_000, 300_000

#: The pattern by which the tokenizer at hand cuts words; a fixed value.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a plain word does not hold: an apostrophe, a sign that may begin a special token, and all but ASCII and Latin-1 letters.
_ODD = re.compile("[^\x21-\x26\x28-\x3b\x3d-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: Bytes that byte-level tokenizers write as other letters, by their own rule: those that cannot be printed follow from 256 on.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each length, and the bins' loads."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    loads: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin with r places left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask &= ~(1 << left)
        else:
            b, left = len(loads), capacity
            loads.append(0)
        bins[i], offsets[i] = b, loads[b]
        loads[b] += n
        left -= n
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(loads, np.int64)


def whole_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes one after another, their bounds, and the first word of each document."""
    w = Words(data, offsets)
    return data[w.solid], np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int32), w.first


_KIND = np.full(256, 3, np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:] = 1
_KIND[48:58] = 2
_STRANGE = np.zeros(256, bool)
_STRANGE[:0x21] = _STRANGE[0x7F:] = True
_STRANGE[[ord("'"), ord("<")]] = True


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like whole_words, with plain words in lower case and cut into runs of letters, single digits and runs of other signs."""
    w = Words(data, offsets)
    lead = data == 0xC3  # begins the letters from U+00C0 to U+00FF
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    latin = after & (data != 0x97) & (data != 0xB7)  # but for the signs of times and division
    strange = _STRANGE[data] & ~lead & ~latin & w.solid
    upto = np.concatenate([[0], np.cumsum(strange, dtype=np.int64)])
    odd_word = upto[w.ends] > upto[w.starts]
    sizes = w.ends - w.starts
    odd = np.repeat(odd_word, sizes)  # from here on without the white space
    body, latin = data[w.solid], latin[w.solid]
    kind = _KIND[body]
    begin = np.zeros(len(body), bool)
    if len(body):
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin &= ~odd
        begin[np.cumsum(sizes) - sizes] = True
    upper = ~odd & (((body >= 65) & (body < 91)) | (latin & (body < 0x9F)))
    body = body + np.where(upper, np.uint8(32), np.uint8(0))
    starts = np.flatnonzero(begin)
    at = np.concatenate([[0], np.cumsum(w.solid, dtype=np.int64)])[offsets]
    return body, np.append(starts, len(body)).astype(np.int32), np.searchsorted(starts, at)


class WordIds:
    """Token ids of words, remembered in one flat array."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        # the direct way holds for lower-casing tokenizers that split by one pattern before byte letters
        read = json.loads(spec)
        cut = ((read.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        names = [x.get("type") for x in (read.get("normalizer") or {}).get("normalizers", [])]
        self.direct = cut == _CUT and names == ["NFC", "Replace", "Lowercase"]
        self.reset()

    def reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.array([END], np.uint32), np.array([0]), np.array([1])  # slot 0: the end mark

    def encode(self, part: str) -> list[int]:
        """The ids of a part of `parts`: of a plain one by the model alone, of any other by the whole tokenizer."""
        if not self.direct or _ODD.search(part):
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_BYTE_LETTERS))]

    def lookup(self, words: list[str]) -> np.ndarray:
        """The words' slots."""
        if len(self.slots) > REMEMBER:
            self.reset()
        new = [w for w in words if w not in self.slots]
        if new:
            found = [self.encode(w) for w in new]
            sizes = np.array([len(x) for x in found])
            base = len(self.sizes)
            self.slots.update((w, base + i) for i, w in enumerate(new))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))])
        return np.fromiter((self.slots[w] for w in words), np.int64, len(words))

    def piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a piece of texts, an end mark after each, and the documents' bounds in them."""
        body, ends, first = parts(data, offsets) if self.direct else whole_words(data, offsets)
        coded = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()
        slots = self.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(ends) > 1 else np.zeros(0, np.int64)
        slots = np.insert(slots, first[1:], 0)
        count = self.sizes[slots]
        upto = np.concatenate([[0], np.cumsum(count)])
        step = np.arange(int(upto[-1])) - np.repeat(upto[:-1], count)
        ids = self.flat[np.repeat(self.starts[slots], count) + step]
        return ids, upto[first + np.arange(len(first))]


@functools.lru_cache(maxsize=1)
def _word_ids(spec: str) -> WordIds:
    return WordIds(spec)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, load long"


def _local(docs: DataFrame, spec: str, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, used = _word_ids(spec), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def pack() -> pa.RecordBatch:
            nonlocal rows, used
            doc, piece, start, length, crc = zip(*rows, strict=True)
            lengths = np.array(length)
            bins, offsets, loads = best_fit(lengths, capacity)
            out = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(lengths), pa.array(crc), pa.array((part << 32) + used + bins), pa.array(offsets), pa.array(loads[bins])], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "load"])
            used += len(loads)
            rows = []
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, _, data, offsets in text_pieces(batch.column(1), 4 << 20):
                ids, bounds = ids_of.piece(data, offsets)
                raw = memoryview(ids.astype("<u4").tobytes())
                for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    for k, at in enumerate(range(a, b, capacity)):
                        to = min(b, at + capacity)
                        rows.append((names[lo + d], k, at - a, to - at, zlib.crc32(raw[4 * at : 4 * to])))
                if len(rows) >= BLOCK:
                    yield pack()
        if rows:
            yield pack()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda x: trimmed(run(x)), _PIECE)


def _merge(items: DataFrame, capacity: int, most: int) -> DataFrame:
    """One level: (bin, node, load) packed within nodes to (bin, parent, shift, node, load of the parent)."""

    def run(group: pa.Table) -> pa.Table:
        names, load = group.column("bin").to_numpy(), group.column("load").to_numpy()
        order = np.lexsort((names, load))
        names, load = names[order], load[order]
        bins, offsets, loads = best_fit(load, capacity)
        # a parent is named after its first item
        head = np.zeros(len(loads), np.int64)
        head[bins[offsets == 0]] = names[offsets == 0]
        node = np.full(len(names), group.column("node")[0].as_py())
        return pa.Table.from_arrays([pa.array(x) for x in (names, head[bins], offsets, node, loads[bins])], names=["bin", "parent", "shift", "node", "load"])

    parts = items.groupBy("node").agg(F.ceil(F.count("*") / F.lit(most)).alias("parts"))
    dealt = items.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("bin"), F.col("parts")))
    return dealt.groupBy("node", "part").applyInArrow(run, "bin long, parent long, shift long, node long, load long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, fan: int = FAN, most: int = MOST, nearly: float = NEARLY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    tokenizer: path of a file of the tokenizers library that drops white space.
    """
    local = materialize(_local(docs, Path(tokenizer).read_text(), capacity), "pieces")
    limit = int(capacity * nearly)
    items = local.where(F.col("load") < limit).groupBy("bin").agg(F.max("load").alias("load")).withColumn("node", F.shiftright("bin", 32))
    top = items.agg(F.max("node")).first()[0]
    places = None
    while top is not None:
        items = items.withColumn("node", F.floor(F.col("node") / fan))
        level = materialize(_merge(items.select("bin", "node", "load"), capacity, most), "level")
        if places is None:
            places = level.select("bin", "parent", "shift")
        else:
            above = level.select(F.col("bin").alias("via"), F.col("parent").alias("up"), F.col("shift").alias("more"))
            places = places.join(above, F.col("parent") == F.col("via"), "left").select("bin", F.coalesce("up", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        top //= fan
        if top == 0:
            break
        items = level.where(F.col("load") < limit).groupBy("parent").agg(F.max("load").alias("load"), F.max("node").alias("node")).withColumnRenamed("parent", "bin")
    out = local.drop("load")
    if places is None:
        return out.withColumnRenamed("bin", "sequence_id")
    out = out.join(materialize(places, "places"), "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
