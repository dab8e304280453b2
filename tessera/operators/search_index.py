"""A persisted index of words: immutable segments of postings, deletes, and a manifest that names them.

A segment is a Parquet folder of (term, key, tf, dl, df), in buckets of terms and
sorted by term, so that a query opens the buckets of its terms and reads their
row groups alone; beside it lie the lengths (key, dl) of its documents.  A document that is replaced or
deleted is named in a list of deletes, which hides it in the segments before.
A manifest is written under a name of its own and moved into place, so readers
see an index whole or as it was.  Another session can open it.

The manifest carries the number of documents and of words, and a stamp of what
was indexed; `current` compares the stamp with the files that a table has now.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from .retrieval import B, FEW, K1
from .store import settled, shared_folder

#: Buckets of terms, and the format of manifests.
BUCKETS, FORMAT = 64, 2


def files_stamp(docs: DataFrame) -> str:
    """A digest of the names, lengths and times of the files behind a table; texts are not read."""
    spark = docs.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in sorted(docs.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = at.getFileSystem(conf).getFileStatus(at)
        seen.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.md5(json.dumps(seen).encode()).hexdigest()


class SearchIndex:
    """Segments, deletes and manifest of one index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.version, self.stamp = 0, ""
        self.n_docs, self.n_words = 0, 0
        self.key_type = "long"
        #: Segments with the buckets that they have, and names of lists of deletes with the number of segments that each hides documents of.
        self.segments: list[tuple[str, list[int]]] = []
        self.deletes: list[tuple[str, int]] = []

    # ------------------------------------------------------------ storage

    def _fs(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchIndex | None:
        """The index that the newest manifest in a folder describes, if there is one."""
        new = cls(spark, path)
        fs, at = new._fs(f"{new.path}/manifests")
        if not fs.exists(at):
            return None
        names = sorted(n for n in (x.getPath().getName() for x in fs.listStatus(at)) if n.endswith(".json"))
        if not names:
            return None
        held = json.loads(spark.read.text(f"{new.path}/manifests/{names[-1]}").first()[0])
        if held.pop("format", None) != FORMAT:
            return None
        for k, v in held.items():
            setattr(new, k, [tuple(x) for x in v] if k in ("segments", "deletes") else v)
        return new

    def _commit(self) -> None:
        """Write the next manifest; if another writer has taken its number, the one after."""
        fs, folder = self._fs(f"{self.path}/manifests")
        fs.mkdirs(folder)
        taken = [int(n[:-5]) for n in (x.getPath().getName() for x in fs.listStatus(folder)) if n.endswith(".json")]
        self.version = max([self.version, *taken])
        while True:
            self.version += 1
            _, temporary = self._fs(f"{self.path}/manifests/_{uuid.uuid4().hex}")
            out = fs.create(temporary)
            out.write(bytearray(json.dumps({"format": FORMAT} | {k: getattr(self, k) for k in ("buckets", "version", "stamp", "n_docs", "n_words", "key_type", "segments", "deletes")}).encode()))
            out.close()
            if fs.rename(temporary, self._fs(f"{self.path}/manifests/{self.version:010d}.json")[1]):
                return
            fs.delete(temporary, False)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            fs, at = self._fs(f"{self.path}/{name}")
            fs.delete(at, True)

    # ------------------------------------------------------------ writing

    def _segment(self, postings: DataFrame, lengths: DataFrame) -> tuple[str, list[int]]:
        """Write a segment; a frequent term's postings are dealt to several tasks by key."""
        name = f"segment-{uuid.uuid4().hex}"
        postings = settled(postings.select("term", "key", "tf", "dl"))
        rows = postings.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int"))
        rows.repartitionByRange("bucket", "term", "key").sortWithinPartitions("bucket", "term", "key").write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")
        lengths.write.parquet(f"{self.path}/{name}/lengths")
        fs, at = self._fs(f"{self.path}/{name}/postings")
        return name, sorted(int(n.partition("=")[2]) for n in (x.getPath().getName() for x in fs.listStatus(at)) if n.startswith("bucket="))

    def add(self, docs: DataFrame, key: str, text: str, stamp: str = "") -> None:
        """Index documents; those whose key is known replace what was."""
        cut = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("w")).withColumn("dl", F.size("w").cast("long"))
        lengths = settled(cut.select("key", "dl"))
        self.key_type = lengths.schema["key"].dataType.simpleString()
        if self.segments:
            self._hide(lengths.select("key"))
        postings = cut.select("key", "dl", F.explode("w").alias("term")).groupBy("term", "key", "dl").agg(F.count("*").alias("tf"))
        self.segments.append(self._segment(postings, lengths))
        n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self.n_docs, self.n_words, self.stamp = self.n_docs + n, self.n_words + total, stamp
        self._commit()

    def _hide(self, keys: DataFrame) -> None:
        """Hide documents in all segments so far."""
        gone = settled(self.lengths().join(keys.distinct(), "key", "left_semi"))
        n, total = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if n:
            name = f"deletes-{uuid.uuid4().hex}"
            gone.select("key").write.parquet(f"{self.path}/{name}")
            self.deletes.append((name, len(self.segments)))
            self.n_docs, self.n_words = self.n_docs - n, self.n_words - total

    def delete(self, keys: DataFrame, stamp: str | None = None) -> None:
        """Take documents (key) out."""
        self._hide(keys.select("key"))
        self.stamp = self.stamp if stamp is None else stamp
        self._commit()

    def compact(self) -> None:
        """Merge all segments and deletes into one segment."""
        if len(self.segments) < 2 and not self.deletes:
            return
        old = self._names()
        self.segments, self.deletes = [self._segment(self.postings(), self.lengths())], []
        self._commit()
        self._drop(old)

    # ------------------------------------------------------------ reading

    def _names(self) -> list[str]:
        return [name for name, _ in [*self.segments, *self.deletes]]

    def _live(self, read: Callable[[str, list[int]], DataFrame | None]) -> DataFrame | None:
        """What `read` gives of each segment, without what was deleted."""
        frames = []
        for i, (name, buckets) in enumerate(self.segments):
            df = read(f"{self.path}/{name}", buckets)
            hidden = [d for d, upto in self.deletes if i < upto]
            if df is not None and hidden:
                df = df.join(self.spark.read.schema(f"key {self.key_type}").parquet(*[f"{self.path}/{d}" for d in hidden]).distinct(), "key", "left_anti")
            if df is not None:
                frames.append(df)
        return reduce(DataFrame.unionByName, frames) if frames else None

    def lengths(self) -> DataFrame:
        """(key, dl) of the documents."""
        return self._live(lambda at, _: self.spark.read.schema(f"key {self.key_type}, dl long").parquet(f"{at}/lengths"))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, key, tf, dl, df), of some terms alone: only their buckets are opened.  df: the documents of the term in the row's segment."""
        kind = f"term string, key {self.key_type}, tf long, dl long, df long"

        def read(at: str, buckets: list[int]) -> DataFrame | None:
            wanted = buckets if terms is None else sorted(set(buckets) & {zlib.crc32(x.encode()) % self.buckets for x in terms})
            if not wanted:
                return None
            df = self.spark.read.schema(kind).parquet(*[f"{at}/postings/bucket={b}" for b in wanted])
            return df if terms is None else df.where(F.col("term").isin(terms))

        found = self._live(read)
        return self.spark.createDataFrame([], kind) if found is None else found

    def search(self, queries: DataFrame | dict[object, list[str]]) -> DataFrame:
        """(query_id, key, score, hits): BM25 of the documents that hold a term of a query, and how many of its terms they hold.

        queries: a table (query_id, term), or terms by query.  Up to `FEW` terms
        are looked up; more are joined.
        """
        asked = [(q, x) for q, terms in queries.items() for x in terms] if isinstance(queries, dict) else [(r.query_id, r.term) for r in queries.select("query_id", "term").limit(FEW + 1).collect()]
        if len(asked) > FEW and isinstance(queries, dict):
            queries = self.spark.createDataFrame(asked, ["query_id", "term"])
        average = self.n_words / max(1, self.n_docs)
        if len(asked) <= FEW:
            whose: dict[str, list] = {}
            for q, x in asked:
                if x is not None and q not in whose.setdefault(x, []):
                    whose[x].append(q)
            found = self.postings(sorted(whose))
            if not whose:
                return found.select(F.lit(None).cast("int").alias("query_id"), "key", F.lit(0.0).alias("score"), "tf").withColumnRenamed("tf", "hits")
            df: Column | str = "df"
            if len(self.segments) > 1 or self.deletes:
                counts = {r.term: r.n for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a term, `FEW` at most
                df = F.element_at(F.create_map(*[F.lit(v) for x in whose for v in (x, counts.get(x, 0))]), F.col("term"))
            by = F.create_map(*[v for x, qs in whose.items() for v in (F.lit(x), F.array(*[F.lit(q) for q in qs]))])
            scored = found.withColumn("df", F.col(df) if isinstance(df, str) else df).withColumn("query_id", F.explode(F.element_at(by, F.col("term"))))
        else:
            found = self.postings().drop("df").join(queries.select("term").distinct(), "term", "left_semi")
            scored = found.join(found.groupBy("term").agg(F.count("*").alias("df")), "term").join(queries.select("query_id", "term").distinct(), "term")
        idf = F.ln(1 + (self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
        return scored.groupBy("query_id", "key").agg(F.sum(part).alias("score"), F.count("*").alias("hits"))


_open: dict[tuple[str, str], SearchIndex] = {}
_folders: dict[str, str] = {}


def index_of(docs: DataFrame, key: str, text: str, name: str) -> SearchIndex:
    """The index of a table, opened where it is current, else built anew; its folder is named after `name` and lies in the shared folder."""
    spark = docs.sparkSession
    app = spark.sparkContext.applicationId
    folder = _folders.setdefault(app, shared_folder(spark))
    path = f"{folder}/words-{hashlib.md5(name.encode()).hexdigest()}"
    stamp = files_stamp(docs)
    index = _open.get((app, path)) or SearchIndex.open(spark, path)
    if index is None or index.stamp != stamp:
        fresh = SearchIndex(spark, path)
        fresh.add(docs, key, text, stamp)
        if index:
            index._drop(index._names())
        index = fresh
    _open[app, path] = index
    return index
