"""Operator 13: token ids in binary files, each document compressed by itself with one shared dictionary.

A zstandard dictionary is trained on the id arrays of a bounded sample of
documents and stored beside the files.  Every document's ids, an end mark after
them, are serialized (little-endian, two bytes an id where the vocabulary
allows) and compressed as a frame of their own, so that a short document can be
read without its neighbours and still profits from what documents share.

A folder (in any store that Arrow's file systems reach from every task) holds `dictionary` and pairs of files, one pair a shard, in ascending
doc_id order:

* `NAME.ids`: the frames, one after another;
* `NAME.idx`: a header (magic, bytes an id, number of documents, SHA-256 of the
  dictionary), then four arrays of 64-bit integers: doc_id, place of the frame's
  end, number of ids up to the document's end, and a bit that says whether the
  doc_id is null.

Texts are tokenized and compressed where they are read; only frames are sorted,
by ranges of doc_id.  A task names its files after itself and its attempt and
returns their names; the manifest, written by Spark, lists the files of the
attempts that counted, so a lost or repeated task leaves nothing that is read.
A document's start among all ids is its shard's start, by sums over the manifest
(a row a shard), and its place in the index.

Memory: a task holds one Arrow batch of texts or frames, and the index of one
shard (`SHARD` bytes of frames or `MOST` documents, then the next file begins).

Defined cases: null is an empty text, whose only id is the end mark; null ids
come last; rows that share an id are written each, ordered by their content; an
empty table gives an empty manifest and no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _written, keyed, materialize, shared_dir, table, text_pieces, trimmed
from .packing import WordIds, default_tokenizer

END, LEVEL = 2, 3
#: The dictionary's bytes; the documents it is trained on, and the characters and ids taken of each for that.
DICTIONARY, SAMPLE, SAMPLE_CHARS, SAMPLE_IDS = 64 << 10, 2000, 16 << 10, 2048
#: Bytes of frames, and documents, of a pair of files.
SHARD, MOST = 256 << 20, 1_000_000
_MAGIC, _HEAD = b"TIDS0001", struct.Struct("<8sIQ32s")


class EndedIds(WordIds):
    """Ids of texts with this format's end mark."""

    def __init__(self, spec: str, end: int):
        self.end = end
        super().__init__(spec)

    def reset(self) -> None:
        super().reset()
        self.flat = np.array([self.end], np.uint32)


_tokenizers: dict[tuple[str, int], EndedIds] = {}


def _ids_of(spec: str, end: int) -> EndedIds:
    if (spec, end) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[spec, end] = EndedIds(spec, end)
    return _tokenizers[spec, end]


def _documents(texts: pa.Array, spec: str, end: int) -> Iterator[np.ndarray]:
    """The ids of each text."""
    for _, _, data, offsets in text_pieces(texts, 4 << 20):
        ids, bounds = _ids_of(spec, end).piece(data, offsets)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[a:b]


def trained_dictionary(docs: DataFrame, spec: str, width: int, end: int = END, sample: int = SAMPLE, size: int = DICTIONARY) -> bytes:
    """A dictionary from the serialized ids of `sample` documents, those of the least hashes; empty where there is too little to learn."""
    # a share that leaves about twice the sample, whatever the number of documents, so that few rows meet in the task that picks the least
    share = int(min(1.0, 2 * sample / max(1, docs.count())) * (1 << 40))
    hashed = docs.where("text IS NOT NULL").select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    chosen = hashed.where(F.pmod("h", F.lit(1 << 40)) < share).orderBy("h").limit(sample).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ids[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for ids in _documents(batch.column(0), spec, end)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    samples = sorted(bytes(r.ids) for r in chosen.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b""


def _with(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _frames(docs: DataFrame, spec: str, width: int, dictionary: bytes, end: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_with(dictionary))
        for batch in batches:
            frames, counts = [], []
            for ids in _documents(batch.column(3), spec, end):
                frames.append(pack.compress(ids.astype(f"<u{width}").tobytes()))
                counts.append(len(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(frames, pa.binary()), pa.array(counts, pa.int64())], names=["doc_id", "_id", "_key", "frame", "count"])

    return keyed(docs).select(F.col("doc_id").cast("long"), "_id", "_key", "text").mapInArrow(lambda x: trimmed(run(x)), "doc_id long, _id long, _key long, frame binary, count long")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Shard:
    """A pair of files while it is written."""

    def __init__(self, folder: str, name: str, width: int, digest: bytes):
        self.fs, self.at = _filesystem(folder)
        self.name, self.width, self.digest = name, width, digest
        self.out = self.fs.open_output_stream(f"{self.at}/{name}.ids")
        self.names: list[int | None] = []
        self.ends: list[int] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, frame: bytes, count: int) -> None:
        self.out.write(frame)
        self.bytes += len(frame)
        self.names.append(doc_id)
        self.ends.append(self.bytes)
        self.counts.append(count)

    def close(self) -> tuple[str, int, int, int]:
        self.out.close()
        n = len(self.names)
        with self.fs.open_output_stream(f"{self.at}/{self.name}.idx") as out:
            out.write(_HEAD.pack(_MAGIC, self.width, n, self.digest))
            out.write(np.array([0 if x is None else x for x in self.names], "<i8").tobytes())
            out.write(np.array(self.ends, "<i8").tobytes())
            out.write(np.cumsum(np.array(self.counts, "<i8")).tobytes())
            out.write(np.array([x is None for x in self.names], "<i8").tobytes())
        return self.name, n, sum(self.counts), self.bytes


_MANIFEST = "part int, shard int, name string, documents long, ids long, bytes long, first long, last long"


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """Write docs to folder, a place that every executor sees, and return its manifest: a row a shard, with its documents, ids, bytes and range of doc_ids."""
    from tokenizers import Tokenizer

    spec = Path(tokenizer).read_text()
    width = 2 if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 else 4
    dictionary = trained_dictionary(docs, spec, width, end)
    digest = hashlib.sha256(dictionary).digest()
    fs, at = _filesystem(folder)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/dictionary") as out:
        out.write(dictionary)

    frames = materialize(_frames(docs, spec, width, dictionary, end), "frames")
    sorted_ = frames.repartitionByRange("_id", "_key").sortWithinPartitions("_id", "_key", "frame").select("doc_id", "_id", "frame", "count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, now, first, last = TaskContext.get(), [], None, 0, 0

        def finish() -> None:
            done.append((task.partitionId(), len(done), *now.close(), first, last))

        for batch in batches:
            for name, key, frame, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and (now.bytes >= shard or len(now.names) >= most):
                    finish()
                    now = None
                if now is None:
                    now, first = _Shard(folder, f"{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}", width, digest), key
                now.add(name, frame, count)
                last = key
        if now is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in _MANIFEST.split(", ")), row, strict=True)) for row in done], schema=pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in _MANIFEST.split(", ")]))

    return materialize(sorted_.mapInArrow(run, _MANIFEST), "manifest")


def _opened(folder: str, name: str, dictionary: bytes) -> tuple[pa.NativeFile, int, np.ndarray]:
    """The frames' file of a shard, bytes an id, and the index's four arrays; the dictionary must be the one that the shard was written with."""
    fs, at = _filesystem(folder)
    with fs.open_input_stream(f"{at}/{name}.idx") as index:
        raw = index.read()
    magic, width, n, digest = _HEAD.unpack_from(raw)
    if magic != _MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError(f"{name} is of another format or dictionary")
    return fs.open_input_file(f"{at}/{name}.ids"), width, np.frombuffer(raw, "<i8", 4 * n, _HEAD.size).reshape(4, n)


def stored_dictionary(folder: str) -> bytes:
    fs, at = _filesystem(folder)
    with fs.open_input_stream(f"{at}/dictionary") as file:
        return file.read()


def _starts(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's start among all ids."""
    before = F.sum("ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    return manifest.withColumn("begin", F.coalesce(before, F.lit(0)))


#: Bytes of frames read at once, and documents of an Arrow batch.
_READ, _ROWS = 8 << 20, 5000


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    dictionary = stored_dictionary(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_with(dictionary))
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, width, (names, ends, upto, null) = _opened(folder, name, dictionary)
                counts = np.diff(upto, prepend=0)
                lo, n = 0, len(names)
                while lo < n:
                    base = int(ends[lo - 1]) if lo else 0
                    hi = min(max(lo + 1, int(np.searchsorted(ends, base + _READ, "right"))), lo + _ROWS)
                    raw = memoryview(file.read_at(int(ends[hi - 1]) - base, base))
                    crcs, at = [], 0
                    for k in range(lo, hi):
                        to = int(ends[k]) - base
                        ids = np.frombuffer(unpack.decompress(raw[at:to]), f"<u{width}")
                        if len(ids) != counts[k]:
                            raise ValueError(f"{name}: document {k} has {len(ids)} ids, its index says {counts[k]}")
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        at = to
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi], mask=null[lo:hi] != 0), pa.array(begin + upto[lo:hi] - counts[lo:hi]), pa.array(counts[lo:hi]), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    lo = hi
                file.close()

    shards = _starts(manifest).select("name", "begin", "part", "shard")
    spread = shards.repartitionByRange(max(1, manifest.count()), "part", "shard").select("name", "begin")  # a shard a task
    return spread.mapInArrow(lambda x: trimmed(run(x)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents in `wanted` (doc_id): only the shards that may hold them are opened, and only their frames are read."""
    dictionary = stored_dictionary(folder)
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    # shards are ranges of ids: one a shard is far fewer than documents, so Spark joins by ranges
    pairs = asked.join(manifest.select("name", "first", "last"), F.col("doc_id").between(F.col("first"), F.col("last"))).select("name", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, name, file = zstandard.ZstdDecompressor(dict_data=_with(dictionary)), None, None
        for batch in batches:
            for at, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != name:
                    name = at
                    file, width, (names, ends, _, null) = _opened(folder, name, dictionary)
                    keys = np.where(null != 0, np.iinfo(np.int64).max, names)
                found = []
                for k in range(int(np.searchsorted(keys, doc_id, "left")), int(np.searchsorted(keys, doc_id, "right"))):
                    begin = int(ends[k - 1]) if k else 0
                    found.append(np.frombuffer(unpack.decompress(file.read_at(int(ends[k]) - begin, begin)), f"<u{width}").tolist())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return pairs.repartition(max(1, manifest.count()), "name").sortWithinPartitions("name", "doc_id").mapInArrow(run, "doc_id long, ids array<long>")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tessera/token-files-{uuid.uuid4().hex}"
    _written.append((spark, folder))
    return read(write(table(spark, sf_dir, "documents"), folder, default_tokenizer()), folder)
