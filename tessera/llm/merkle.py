"""Operator 12: a Merkle manifest of a dataset, built and verified in supersteps over RDDs.

A row's leaf is the digest of its columns.  Per source the leaves, by doc_id, are
the lowest level of a tree whose runs of three nodes have one parent; the
subroots, by source, are the leaves of one more such tree, whose top is the root.

Upward, each superstep lets the nodes message their parents; a parent that has
all of its run hashes them and messages its own parent in the next superstep.
Downward, each superstep lets a parent send its children the siblings of its way
to the root, to which each child adds the others of its run; at the leaves the
way is folded again, from the leaf as it is stored (which may be tampered with),
and compared with the root.  A message has at most two digests a level, a node
gets at most three.  The runs of every level are written to the shared folder.

Leaves get their places from one sort by source and doc_id and the sizes of its
ranges, so a hot source is spread over many ranges and its nodes over all tasks.

Defined cases: null columns are `-` in a leaf; null sources come first, null ids
last; rows of one id go by their leaves; a null id is not tampered with; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_path, materialize, shared_dir, table
from .sql import CRC32_STEPS, crc32

FAN = 3
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest_of(columns: Iterable[Column]) -> Column:
    """The digest of columns: each `-`, or its length in bytes and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def above(digests: Iterable[bytes]) -> bytes:
    """The digest of digests, as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """rows with `g` (ascends as the group, null first), `i` (place in the group, from 0) and `n` (size of the group)."""
    sorted_ = rows.orderBy(F.col(group).asc_nulls_first(), *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(sorted_, name).withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy("_range", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    of = Window.partitionBy(group)  # a row a range
    before = F.coalesce(F.sum("_n").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_range").alias("_r"), F.col(group).alias("_group"), "_first", before.alias("_before"), F.sum("_n").over(of).alias("n"), F.min("_first").over(of).alias("g"))
    out = placed.join(runs, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_r", "_first", "_before", "_group")


class _Supersteps:
    """Levels of nodes ((tree, place), (nodes of the level, digest, what a leaf carries)); each level takes a third of the tasks of the one below."""

    def __init__(self, spark: SparkSession, leaves: RDD, most: int, name: str):
        self.spark, self.name = spark, name
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: list[str] = []
        #: runs[l]: the nodes of level l + 1 with their children of level l.
        self.runs: list[RDD] = []
        nodes, tops = leaves, []
        while True:
            level = len(self.runs)
            tops.append(nodes.filter(lambda x: x[1][0] == 1).map(lambda x, at=level: (x[0][0], (at, x[1][1], x[1][2]))))
            if most <= 1:
                break
            sent = nodes.filter(lambda x: x[1][0] > 1).map(lambda x: ((x[0][0], x[0][1] // FAN), (x[0][1] % FAN, *x[1])))
            done = self._written(self._sent(sent, level).mapPartitions(complete_runs), level)
            self.runs.append(done)
            nodes = done.map(lambda x: (x[0], (-(-x[1][0][1] // FAN), above(c[2] for c in x[1]), None)))
            most = -(-most // FAN)
        #: (tree, (level, digest, what a lone leaf carries)) of each tree's top.
        self.tops = self._written(spark.sparkContext.union(tops), 1)

    def _width(self, level: int) -> int:
        return max(2, -(-self.parts // FAN**level))

    def _sent(self, messages: RDD, level: int) -> RDD:
        """The messages, those to one node in one partition."""
        n = self._width(level)
        return messages.partitionBy(n).coalesce(n)

    def _written(self, rdd: RDD, level: int) -> RDD:
        path = f"{shared_dir(self.spark)}/tessera/{self.name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        rdd.coalesce(self._width(level)).saveAsPickleFile(path)
        return self.spark.sparkContext.pickleFile(path).coalesce(self._width(level))

    def leaves(self, starts: RDD) -> RDD:
        """(tree, what the leaf carries, digest, the top's start, ((place, siblings), ...) upward) of each leaf; starts: (tree, start) of each tree."""
        tops = self._written(self._sent(tagged(self.tops, starts), 1).mapPartitions(matched), 1)
        levels = set(tops.map(lambda x: x[1][0][0]).distinct().collect())  # at most as many as there are levels
        nodes = None
        for level in range(len(self.runs), -1, -1):
            if level in levels:
                here = tops.filter(lambda x, at=level: x[1][0][0] == at).map(lambda x: ((x[0], 0), (x[1][0][1], x[1][0][2], x[1][1], ())))
                nodes = here if nodes is None else nodes.union(here)
            if level:
                nodes = self._sent(tagged(nodes, self.runs[level - 1]), level - 1).mapPartitions(matched).flatMap(to_children)
        return nodes.map(lambda x: (x[0][0], x[1][1], x[1][0], x[1][2], x[1][3]))

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)


def complete_runs(messages: Iterable[tuple]) -> Iterable[tuple]:
    """The parents that a partition's messages go to, each with its children in order."""
    found: dict[tuple, list[tuple]] = {}
    for key, child in messages:
        found.setdefault(key, []).append(child)
    return ((key, sorted(run, key=lambda m: m[0])) for key, run in found.items())


def tagged(left: RDD, right: RDD) -> RDD:
    return left.map(lambda x: (x[0], (0, x[1]))).union(right.map(lambda x: (x[0], (1, x[1]))))


def matched(messages: Iterable[tuple]) -> Iterable[tuple]:
    """key, (left, right) of the tagged messages of a partition; a key has one of each, or one that finds none."""
    waiting: dict[tuple, tuple] = {}
    for key, (side, value) in messages:
        if key not in waiting:
            waiting[key] = (side, value)
            continue
        other, first = waiting.pop(key)
        yield key, ((first, value) if other < side else (value, first))


def to_children(node: tuple) -> list[tuple]:
    (tree, place), ((_, _, start, way), run) = node
    digests = [c[2] for c in run]
    return [((tree, place * FAN + k), (digest, carried, start, ((k, tuple(digests[:k] + digests[k + 1 :])), *way))) for k, _, digest, carried in run]


def fold(digest: bytes, way: Iterable[tuple[int, tuple[bytes, ...]]]) -> bytes:
    """The root that a leaf's digest and the siblings of its way give."""
    for place, others in way:
        digest = above((*others[:place], digest, *others[place:]))
    return digest


def proven(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs.

    docs has a column `tampered`: the text as it is stored now (or null for a null text).
    """
    spark = docs.sparkSession
    leaf, now = digest_of(F.col(c) for c in LEAF), digest_of(F.col("tampered" if c == "text" else c) for c in LEAF)
    leaves = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), now.alias("now"))
    placed = materialize(_numbered(leaves, "source", [F.col("doc_id").asc_nulls_last(), F.col("leaf"), F.col("now")], "merkle-leaves").select("g", "i", "n", "doc_id", "leaf", "now"), "merkle-placed")
    most = placed.agg(F.max("n")).first()[0]
    if not most:
        return spark.createDataFrame([], _OUT)
    rows = placed.rdd.map(lambda r: ((r.g, r.i), (r.n, bytes(r.leaf), (r.doc_id, None if r.now == r.leaf else bytes(r.now)))))
    trees = _Supersteps(spark, rows, most, "merkle-tree")
    subroots = spark.createDataFrame(trees.tops.map(lambda x: (0, x[0], x[1][1])), "one int, tree long, subroot binary", verifySchema=False)
    subroots = materialize(_numbered(subroots, "one", [F.col("tree")], "merkle-subroots").select("i", "n", "tree", "subroot"), "merkle-numbered")
    count = subroots.count()
    over = _Supersteps(spark, subroots.rdd.map(lambda r: ((0, r.i), (r.n, bytes(r.subroot), r.tree))), count, "merkle-top")
    root = over.tops.map(lambda x: (x[0], x[1][1]))
    starts = over.leaves(root).map(lambda x: (x[1], (x[2], x[3], x[4])))  # tree: subroot, root, way from the subroot

    def row(x: tuple) -> tuple:
        _, (doc_id, now), digest, (subroot, root, rest), way = x
        way = (*way, *rest)
        folded = fold(digest if now is None else now, way)
        return doc_id, digest.hex(), subroot.hex(), root.hex(), above(d for _, others in way for d in others).hex(), folded.hex(), folded == root

    out = materialize(spark.createDataFrame(trees.leaves(starts).map(row), _OUT, verifySchema=False), "merkle-proofs")
    over.drop()
    trees.drop()
    return out


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return proven(docs.withColumn("tampered", F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))))


def _sql(levels: int = 21) -> str:
    """The trees and proofs by joins, level by level, up to 3^levels leaves."""
    def part(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"

    same = " || ".join(part(c) for c in LEAF[:-1])
    out = [f"steps AS ({CRC32_STEPS})", f"docs AS (SELECT *, CASE WHEN {crc32('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents, steps)",
           f"leaves AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, sha256({same} || {part('text')}) AS h, sha256({same} || {part('tampered')}) AS now FROM docs)",
           "a0 AS (SELECT source AS g, i, n, h FROM leaves)"]

    def climb(t: str) -> None:
        for k in range(levels):
            out.append(f"{t}r{k} AS MATERIALIZED (SELECT g, i // 3 AS j, list(h ORDER BY i) AS hs FROM {t}{k} WHERE n > 1 GROUP BY g, i // 3)")
            out.append(f"{t}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, (any_value(n) + 2) // 3 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {t}{k} GROUP BY g, i // 3)")

    def walk(t: str, first: str, name: str) -> None:
        out.append(first)
        for k in range(levels):
            out.append(f"{name}{k + 1} AS (SELECT p.* EXCLUDE (i, n, now, proof), i // 3 AS i, (n + 2) // 3 AS n, CASE WHEN hs IS NULL THEN now ELSE sha256(array_to_string(hs[:i % 3] || [now] || hs[i % 3 + 2:], '')) END AS now, CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(list_filter(hs, lambda x, k: k <> i % 3 + 1), '') END AS proof FROM {name}{k} p LEFT JOIN {t}r{k} r ON p.g IS NOT DISTINCT FROM r.g AND r.j = p.i // 3)")

    climb("a")
    walk("a", "p0 AS (SELECT doc_id, source AS g, h AS leaf, i, n, now, '' AS proof FROM leaves)", "p")
    out.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, g AS source FROM a{levels})")
    climb("b")
    walk("b", f"q0 AS (SELECT doc_id, leaf, b0.h AS subroot, 0 AS g, b0.i, b0.n, now, proof FROM p{levels} p JOIN b0 ON p.g IS NOT DISTINCT FROM b0.source)", "q")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = b.h AS verified FROM q{levels}, b{levels} b"


OP12_SQL = _sql()
