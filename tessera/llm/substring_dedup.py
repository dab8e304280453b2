"""Operator 1: incremental substring dedup with a log-structured fingerprint index.

Every window of `window` words is represented by its block (see
`common.blocks`): an anchor fingerprint shared by all equal windows, and a
128-bit digest of the words that the block's windows cover.  The index holds,
per distinct block, the first document that has it.  It is log-structured: each
batch adds one immutable run, bucketed and sorted by fingerprint; a new batch is
merge-joined with the runs of the past to find the fingerprints that it shares
with them; runs are compacted into one when `fanout` of them have gathered.  A
manifest in the index's folder names the runs, so another session can open the
index and go on.

Blocks of equal digest settle at once: all but the first document lose them.
Blocks that share only the fingerprint are verified window by window, by digests
of the windows' words.  Only those blocks, one representative each, are looked
up again in the texts, so copies never meet pairwise; the index itself holds no
texts, and verification reads the table of earlier documents that it is given.

Defined cases: a null or empty text has no words; a text shorter than the
window loses nothing; rows that share a doc_id never remove words from each
other (an equal id is not smaller); null ids count as larger than all others;
batches come in ascending order of ids, a smaller id that comes later removes
nothing from those before; extra columns are ignored.  A kernel holds one text
at a time, at about 60 bytes a byte.
"""

from __future__ import annotations

import contextlib
import functools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Words, _written, blocks, digests, drop_path, forget, keyed, materialize, shared_dir, table, text_pieces, trimmed

WINDOW, GRAM, BATCHES, FANOUT = 50, 16, 4, 3

#: A block's fingerprint and the digest of its words.
KEY = ("fp", "c1", "c2")
_PLACE = "struct<_id:long,_key:long,start:int,n:int>"
_ROW = f"fp long, c1 long, c2 long, rep {_PLACE}, copies long"


def _postings(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, data, offsets in text_pieces(batch.column(2)):
                words = Words(data, offsets)
                b = blocks(words.hashes(), words.first, window, gram)
                body, bound = words.joined()
                c1, c2 = digests(body, bound[b["at"]], bound[b["at"] + b["n"] + window - 1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[lo:hi][b["doc"]], keys[lo:hi][b["doc"]], b["fp"], c1, c2, b["start"].astype(np.int32), b["n"].astype(np.int32))], names=["_id", "_key", "fp", "c1", "c2", "start", "n"])

    return docs.select("_id", "_key", "text").mapInArrow(lambda x: trimmed(run(x)), "_id long, _key long, fp long, c1 long, c2 long, start int, n int")


@contextlib.contextmanager
def _stored_order(spark: SparkSession) -> Iterator[None]:
    """Lets plans rely on the order in which buckets of one file are stored, so that runs are merged without a sort."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _reps(rows: DataFrame) -> DataFrame:
    """Per distinct block: its first document's place, and how often it occurs."""
    return rows.groupBy(*KEY).agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies"))


class FingerprintIndex:
    """Immutable runs of (fp, c1, c2, rep, copies), bucketed by fp and sorted, named by a manifest."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, buckets: int | None = None):
        if not 0 < window - gram < 62:
            raise ValueError("a block's windows are kept in the bits of a long: 0 < window - gram < 62")
        self.spark, self.path, self.window, self.gram, self.fanout = spark, path.rstrip("/"), window, gram, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.version = 0

    def _fs(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that the newest manifest in a folder describes."""
        new = cls(spark, path)
        fs, at = new._fs(f"{new.path}/manifests")
        names = sorted(x.getPath().getName() for x in fs.listStatus(at))
        newest = [x for x in names if x.endswith(".json")][-1]
        held = json.loads(spark.read.text(f"{new.path}/manifests/{newest}").first()[0])
        new = cls(spark, path, held["window"], held["gram"], held["fanout"], held["buckets"])
        new.version, new.runs = held["version"], held["runs"]
        for name in new.runs:  # a new session's catalog does not know the tables
            if not spark.catalog.tableExists(name):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.schema(_ROW).parquet(f"{new.path}/{name}").schema)
                spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {new.buckets} BUCKETS LOCATION '{new.path}/{name}'")
                _written.append((spark, f"table:{name}"))
        return new

    def _commit(self) -> None:
        """Write the next manifest, under a name that is whole or not there."""
        self.version += 1
        fs, temporary = self._fs(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps({"version": self.version, "window": self.window, "gram": self.gram, "fanout": self.fanout, "buckets": self.buckets, "runs": self.runs}).encode()))
        out.close()
        fs.rename(temporary, self._fs(f"{self.path}/manifests/{self.version:010d}.json")[1])

    def _write(self, rows: DataFrame) -> str:
        name = f"tessera_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "fp").sortWithinPartitions("fp", "c1").write.bucketBy(self.buckets, "fp").sortBy("fp").option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        _written.append((self.spark, f"table:{name}"))
        return name

    def rows(self) -> DataFrame:
        """All blocks of all runs; a block may stand in several runs before compaction."""
        if len(self.runs) == 1:
            return self.spark.table(self.runs[0])
        # as plain files: a union of bucketed scans must not pass for one bucketed table
        return self.spark.read.schema(_ROW).parquet(*[f"{self.path}/{x}" for x in self.runs])

    def lookup(self, fps: DataFrame) -> DataFrame:
        """The blocks of the given fingerprints (fp), each once."""
        return _reps(self.rows().join(fps, "fp", "left_semi"))

    def append(self, batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        """Add a batch as a run and remove from its texts what it or earlier documents have at smaller ids.

        batch and earlier have doc_id and text; earlier holds the documents
        appended before.  Returns doc_id, n_words, n_removed, kept_text and removed.
        """
        docs = keyed(batch)
        postings = materialize(_postings(docs, self.window, self.gram), "postings")
        name = self._write(_reps(postings.select(*KEY, F.struct("_id", "_key", "start", "n").alias("rep"), F.lit(1).cast("long").alias("copies"))))
        new = self.spark.table(name)
        # to verify: fingerprints that the run has with several contents, or that a merge join finds in an earlier run with another one
        doubt = new.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1").select("fp")
        with _stored_order(self.spark):
            doubt = materialize(functools.reduce(DataFrame.union, (self._merged(new, run) for run in self.runs), doubt).distinct(), "doubt")
        met = new.select(*KEY, "rep", "copies")
        if self.runs:
            met = met.unionByName(self.rows().join(new.select(*KEY), list(KEY), "left_semi").select(*KEY, "rep", "copies"))
        self.runs.append(name)
        self._commit()
        doubtful = self.lookup(doubt).select(*KEY, "rep.*")
        seen = materialize(_windows(docs if earlier is None else docs.unionByName(keyed(earlier)), doubtful, self.window), "windows")
        least = seen.groupBy("fp", "w1", "w2").agg(F.min("_id").alias("least"))
        masks = seen.join(least, ["fp", "w1", "w2"]).where("least < _id").groupBy(*KEY).agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"))
        verdict = _reps(met).where("copies > 1").select(*KEY, F.col("rep._id").alias("first"), F.lit(0).cast("long").alias("mask")).unionByName(masks.withColumn("first", F.lit(None).cast("long")), allowMissingColumns=True)
        # written, so that the join below reads two plain exchanges and can split a hot block
        verdict = materialize(verdict.groupBy(*KEY).agg(F.min("first").alias("first"), F.bit_or("mask").alias("mask")), "verdict")
        removed = postings.join(verdict, list(KEY)).select("_id", "_key", "start", F.expr("CASE WHEN _id > first THEN shiftleft(1L, n) - 1 ELSE mask END").alias("bits")).where("bits <> 0")
        removed = materialize(removed, "removed")
        forget(postings, doubt, seen, verdict)
        return _cut(docs, removed, self.window)

    def _merged(self, new: DataFrame, run: str) -> DataFrame:
        """The fingerprints of a run that an earlier one has with another content: both are read in their stored order and merged."""
        past = self.spark.table(run).select(F.col("fp").alias("past_fp"), F.col("c1").alias("p1"), F.col("c2").alias("p2"))
        return new.select(*KEY).hint("merge").join(past, F.expr("fp = past_fp AND (c1 <> p1 OR c2 <> p2)"), "left_semi").select("fp")

    def compact(self, force: bool = False) -> None:
        """Merge the runs into one if `fanout` have gathered."""
        if len(self.runs) < 2 or not (force or len(self.runs) >= self.fanout):
            return
        old, self.runs = self.runs, [self._write(_reps(self.rows()))]
        self._commit()
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, f"{self.path}/{name}")


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The digest of every window of the wanted blocks, read again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            at = lists.offsets.to_numpy()
            names = [*KEY, "start", "n"]
            flat = dict(zip(names, (x.to_numpy(zero_copy_only=False) for x in lists.values.flatten()), strict=True))
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                words = Words(data, offsets)
                body, bound = words.joined()
                own = slice(at[lo], at[hi])
                start, n = flat["start"][own], flat["n"][own]
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                block = np.repeat(np.arange(len(doc)), n)
                off = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
                place = words.first[doc][block] + start[block] + off
                w1, w2 = digests(body, bound[place], bound[place + window])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(flat[k][own][block] for k in KEY), ids[lo:hi][doc][block], off.astype(np.int32), w1, w2)], names=[*KEY, "_id", "off", "w1", "w2"])

    lists = wanted.groupBy("_id", "_key").agg(F.collect_list(F.struct(*KEY, "start", "n")).alias("blocks"))
    return docs.select("_id", "_key", "text").join(lists, ["_id", "_key"]).select("_id", "text", "blocks").mapInArrow(lambda x: trimmed(run(x)), "fp long, c1 long, c2 long, _id long, off int, w1 long, w2 long")


def _cut(docs: DataFrame, removed: DataFrame, window: int) -> DataFrame:
    """Apply removed windows (places and bit masks) to the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.flatten()
            start, bits = (x.to_numpy(zero_copy_only=False) for x in flat)
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                words = Words(data, offsets)
                total = len(words.starts)
                own = slice(at[lo], at[hi])
                place = words.first[:-1][np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))] + start[own]
                edge = np.zeros(total + 1, np.int32)
                for b in range(int(bits[own].max(initial=0)).bit_length()):
                    hit = place[(bits[own] >> b) & 1 == 1] + b
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                keep = np.flatnonzero(~gone)
                doc = np.searchsorted(words.first, keep, "right") - 1
                last = np.ones(len(keep), bool)
                last[:-1] = doc[1:] != doc[:-1]
                out, mark = words.data.copy(), np.zeros(len(data) + 2, np.int8)
                ends = words.ends[keep] + ~last
                out[words.ends[keep][~last]] = 0x20
                np.add.at(mark, words.starts[keep], 1)
                np.add.at(mark, ends, -1)
                kept = np.cumsum(mark[: len(data)], dtype=np.int8).astype(bool)
                sizes = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[offsets]
                lost = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])[words.first]
                # removed ranges, as word numbers of the document
                cut = np.zeros(total + 1, bool)
                cut[words.first[:-1][words.first[:-1] < total]] = True
                head = np.flatnonzero(gone & (np.concatenate([[True], ~gone[:-1]]) | cut[:-1]))
                tail = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]]) | np.concatenate([cut[1:-1], [True]]))) + 1
                whose = np.searchsorted(words.first, head, "right") - 1
                base = words.first[whose]
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(hi - lo + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array((head - base).astype(np.int64)), pa.array((tail - base).astype(np.int64))], names=["start", "end"]))
                text = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(out[kept])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.first).astype(np.int64)), pa.array(np.diff(lost)), text.cast(pa.string()), spans], names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    lists = removed.groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "bits")).alias("cuts"))
    return docs.join(lists, ["_id", "_key"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("cuts", F.expr("cast(array() as array<struct<start:int,bits:bigint>>)")).alias("cuts")).mapInArrow(lambda x: trimmed(run(x)), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Remove the words of windows that also start in a document with a smaller doc_id.

    docs has doc_id and text; it is appended to a new index in `batches` ranges
    of ids.  Returns doc_id, n_words, n_removed, kept_text (kept words joined by
    one space) and removed (ranges of word numbers).
    """
    spark, rows = docs.sparkSession, docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_at"))
    limits = rows.agg(F.percentile_approx("_at", [i / batches for i in range(1, batches)] or [1.0], 1000)).first()[0] or []
    limits = sorted(set(limits[: batches - 1]))
    path = f"{shared_dir(spark)}/tessera/index-{uuid.uuid4().hex}"
    _written.append((spark, path))
    index, out = FingerprintIndex(spark, path, window, gram, fanout), None
    for low, high in zip([None, *limits], [*limits, None], strict=True):
        earlier = None if low is None else rows.where(F.col("_at") <= low)
        part = rows if low is None else rows.where(F.col("_at") > low)
        part = part if high is None else part.where(F.col("_at") <= high)
        found = index.append(part, earlier)
        out = found if out is None else out.unionByName(found)
        index.compact()
    return out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


#: The same by plain SQL: every window's words as text.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d),
h AS (SELECT s.doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS k FROM s JOIN d USING (doc_id)),
m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN m USING (k) WHERE least < doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
u AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT u.doc_id, string_agg(t, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.i = r.i WHERE r.i IS NULL GROUP BY u.doc_id)
SELECT k.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN x ON k.doc_id = x.doc_id
"""
