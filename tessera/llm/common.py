"""What the corpus operators share: tables, shared storage, text kernels.

The kernels work on Arrow batches.  They cut a batch into pieces of about
`PIECE` bytes, so memory is bounded by the piece (or by one long document),
never by the partition.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a kernel takes at once.
PIECE = 1 << 20
#: Stands for a null id inside an operator; null ids sort last.
NULL_ID = (1 << 63) - 1

#: How intermediates are written.  Folders of the file scheme get no checksum files beside the data; other stores take no notice.
PLAIN = {"compression": "zstd", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_written: list[tuple[SparkSession, str]] = []
#: Folders of applications without a shared one.
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where that is unset the warehouse, and in local mode a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.split("[")[0] == "local":
        at = spark.conf.get("spark.sql.warehouse.dir")
        if at.startswith("file:") or "://" not in at:
            raise RuntimeError(f"spark.checkpoint.dir is unset, and the warehouse {at} is a folder of one machine: set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        app = spark.sparkContext.applicationId
        at = _local.get(app) or _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return at.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that `materialize` wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            if path.startswith("table:"):
                spark.sql(f"DROP TABLE IF EXISTS {path[6:]}")
            else:
                drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; its owner clears the folder
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of `materialize` that later ones have replaced."""
    for df in frames:
        drop_path(df.sparkSession, df._tessera_path)


# ---------------------------------------------------------------- text kernels


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Odd multipliers: of the left half, of the right half, of the mixing.
_LEFT, _RIGHT, _MORE = (np.uint64(int(_mix(np.array([i + 11], np.uint64))[0]) | 1) for i in range(3))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order; the mixing leaves no algebra between ranges of different content."""
    out = a * _LEFT
    out += b * _RIGHT
    out ^= out >> np.uint64(32)
    out *= _MORE
    out ^= out >> np.uint64(29)
    return out


def window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of `length` values: halves are paired, so log2(length) passes do."""
    have, out = 1, values
    while have * 2 <= length:
        out = _pair(out[: max(0, len(out) - have)], out[have:])
        have *= 2
    if have < length:
        step = length - have
        out = _pair(out[: max(0, len(out) - step)], out[step:])
    return out


def range_hashes(values: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of values, of its length and of the two runs of a power of two that cover it."""
    out = length.astype(np.uint64)
    level = np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1
    run, have = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            run = _pair(run[: len(run) - have], run[have:])
            have *= 2
        pick = np.flatnonzero((level == k) & (length > 0))
        if len(pick):
            first = at[pick]
            out[pick] = _pair(_pair(run[first], run[first + length[pick] - have]), out[pick])
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit cryptographic digests of byte ranges, as two columns of longs: equal digests stand for equal bytes."""
    raw, one = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    found = b"".join([one(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(found, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a piece: byte ranges, and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        solid = self.solid = ~_SPACE[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0], edge[1:] = True, ~solid
        edge[offsets] = True  # a document's end also ends a word
        self.starts = np.flatnonzero(solid & edge[:-1])
        edge[-1] = True
        edge[:-1] = ~solid
        edge[offsets] = True
        self.ends = np.flatnonzero(solid & edge[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return range_hashes(byte_values(self.data), self.starts, self.ends - self.starts)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes with one blank after each, and the words' bounds in them (the blank counts to its word)."""
        size = self.ends - self.starts + 1
        bound = np.concatenate([[0], np.cumsum(size)])
        out = np.full(int(bound[-1]), 0x20, np.uint8)
        inside = np.ones(len(out), bool)
        inside[bound[1:] - 1] = False
        out[inside] = self.data[self.solid]
        return out, bound


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, in about log2(width) passes."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        step = width - have
        out = np.minimum(out[: len(out) - step], out[step:])
    return out


def blocks(values: np.ndarray, first: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Anchored blocks of every window of `window` units, documents apart.

    A window's anchor is its `gram`-unit piece with the least hash, the
    leftmost of equals: it depends on the window's content alone, so equal
    windows have equal anchors at equal places.  A block is a maximal run of
    window starts with one anchor occurrence.  Returned per block: doc (index
    into first), start and n (window starts, relative to the document), at
    (start in values) and fp (hash of the anchor).  Two windows can be equal
    only within blocks of one fp.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "start", "n", "fp", "at")}
    if len(values) < window:
        return empty
    lengths = np.diff(first)
    grams = window_hashes(values, gram)
    # the high bits of the hash, then the place: the least is the leftmost of equals
    bits = np.uint64(max(22, int(len(grams)).bit_length()))
    least = sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    kept = np.maximum(lengths - window + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), kept)
    if not len(doc):
        return empty
    place = np.arange(len(doc)) - np.repeat(np.cumsum(kept) - kept, kept) + first[:-1][doc]
    anchor = anchor[place]
    new = np.empty(len(doc), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    at, doc = place[head], doc[head]
    return {"doc": doc, "start": at - first[doc], "n": np.diff(np.append(head, len(place))), "fp": grams[anchor[head]].view(np.int64), "at": at}


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; afterwards the worker, which Spark keeps for later tasks, gives its free memory back."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text with an inner key: `_id` (null ids last) and `_key`, which tells rows that share an id apart."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_key"), F.col("text"), *more)
