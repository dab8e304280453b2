"""Operator 7: exact n-gram Jaccard join with skipping by set relations.

1. Every text becomes its set of shingle hashes; equal sets are one class.
2. Candidates, by an exact prefix filter over one global order of shingles:
   those in the lowest quarter of the hash range come first, by their number of
   classes, the rest follow by hash.  A set that links must share a shingle of
   its first n - ceil(t n) + 1; sets whose shingles there occur nowhere else are
   out.  Classes that share such a shingle and are of one size class make a star;
   sizes that can link differ by one class at most, so a set also stands in the
   star above.  Stars of one first class are a group, and two sets that can link
   meet in some group.
3. Within a group the sets are joined exactly, in order of size.  Inverted
   lists are cut into blocks that know their sets' largest size and least place,
   so whole blocks are jumped over.  A set's answers are derived from those of a
   highly similar set met before: the overlaps that set has counted are corrected
   by the shingles in which the two differ, which bounds most candidates without
   a count of their own.  Groups that are too large for a task are cut into
   parts, a task for each pair of parts.
4. Components of the links give the least document reachable.

Only a spanning forest of links leaves a task, so no group emits its pairs, and
no link between different texts is lost.

Defined cases: a null or empty text has an empty set and links with nothing;
copies link; rows that share a doc_id are one vertex; null ids come last and
stay null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Words, digests, forget, keyed, materialize, range_hashes, table, text_pieces, trimmed
from .components import connected_components

WORDS, PERCENT = 4, 85
#: Shingles below this hash are counted over all classes.
COUNTED = np.uint64(1 << 62)
#: Shingle hashes that a task of the exact join holds, about.
TASK = 400_000
#: Entries of a block of an inverted list.
BLOCK = 64


def least_common(n, percent: int):
    """The least overlap with any set that a set of n shingles can link by."""
    return (n * percent + 99) // 100


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document, first of each document) of a piece."""
    w = Words(data, offsets, lower=True)
    h = w.hashes()
    size = np.diff(w.first)
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), count)
    at = w.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(size, words)[doc]
    token = range_hashes(h, at, length)
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(size) + 1))


def _sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: n, a 128-bit digest of the set, and `low`: the shingles that may be in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                token, first = shingles(data, offsets, words)
                n = np.diff(first)
                rank = np.arange(len(token)) - np.repeat(first[:-1], n)
                prefix = np.where(n > 0, n - least_common(n, percent) + 1, 0)
                low = (token < COUNTED) | (rank < np.repeat(prefix, n))
                ends = np.concatenate([[0], np.cumsum(low)])[first].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(token[low].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *map(pa.array, digests(token.view(np.uint8), first[:-1] * 8, first[1:] * 8)), lists], names=["_id", "n", "h1", "h2", "low"])

    return docs.select("_id", "text").mapInArrow(lambda x: trimmed(run(x)), "_id struct<_id:long,_key:long>, n long, h1 long, h2 long, low array<long>")


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(first, rep): groups, named by their first class, in one of which every two classes that can link are together."""
    tokens = classes.select("rep", "_key", "n", F.explode("low").alias("token"))
    counted = f"token >= 0 AND token < {int(COUNTED)}"  # as signed numbers, hashes of the upper half are negative
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.select("rep", "_key", "token").join(often, "token").groupBy("rep", "_key").agg(F.collect_list(F.struct(F.expr(f"CASE WHEN {counted} THEN df ELSE 9223372036854775807 END").alias("df"), F.expr("shiftrightunsigned(token, 1)").alias("place"), "token")).alias("shared"))
    met = classes.select("rep", "_key", "n", F.size("low").alias("all"), F.expr(f"size(filter(low, token -> {counted}))").alias("counted")).join(shared, ["rep", "_key"])
    # counted shingles that occur once come first in the order; uncounted ones come last and take their place by hash
    met = met.withColumn("prefix", F.expr(f"n - (n * {percent} + 99) div 100 + 1")).withColumn("single", F.expr("counted - size(filter(shared, s -> s.df < 9223372036854775807))"))
    picked = met.where("prefix > single").select("rep", "n", F.explode(F.expr("slice(array_sort(shared), 1, cast(prefix - single as int))")).alias("s")).select("rep", "n", "s.token")
    # sets that link differ in size by less than one step, so they are of the same size class or of neighbouring ones
    step = math.log(100 / percent) * 1.001
    sized = materialize(picked.withColumn("class", F.floor(F.ln("n") / step)), "prefixes")
    stars = materialize(sized.groupBy("token", "class").agg(F.min("rep").alias("first"), F.min("n").alias("least"), F.max("n").alias("most")), "stars")
    own = sized.join(stars.select("token", "class", "first"), ["token", "class"]).select("first", "rep")
    above = stars.select("token", (F.col("class") - 1).alias("class"), "first", "least")
    upper = sized.join(above, ["token", "class"]).where(f"n * 100 >= least * {percent}").select("first", "rep")
    members = materialize(own.unionByName(upper).distinct(), "members")
    forget(sized, stars)
    return members


class Lists:
    """Inverted lists over the prefixes of sets, in order of size: for each shingle the sets and the shingle's place in them.

    Lists are cut into blocks of `BLOCK` entries; a block's least place is kept, its largest size is its last set's.
    """

    def __init__(self) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}

    def add(self, token: int, number: int, place: int) -> None:
        sets, places, least, used = self.of.get(token) or (np.zeros(4, np.int32), np.zeros(4, np.int32), np.zeros(1, np.int32), 0)
        if used == len(sets):
            sets, places = (np.concatenate([x, np.zeros(used, np.int32)]) for x in (sets, places))
            least = np.concatenate([least, np.zeros(-(-len(sets) // BLOCK) - len(least), np.int32)])
        sets[used], places[used] = number, place
        block = used // BLOCK
        least[block] = place if used % BLOCK == 0 else min(least[block], place)
        self.of[token] = sets, places, least, used + 1

    def candidates(self, token: int, n: int, place: int, sizes: np.ndarray, open_: np.ndarray, percent: int) -> list[int]:
        """Open sets of the list that can still share enough with a set of n, met at this place; blocks that cannot are jumped over."""
        found = self.of.get(token)
        if found is None:
            return []
        sets, places, least, used = found
        blocks = -(-used // BLOCK)
        picked = slice(0, used)
        if blocks > 1:  # sizes rise along the list: a block's first set is its smallest, its last the largest
            smallest, largest = sizes[sets[: used : BLOCK]], sizes[sets[np.minimum(np.arange(1, blocks + 1) * BLOCK, used) - 1]]
            on = (largest * 100 >= percent * n) & (np.minimum(n - place, largest - least[:blocks]) * (100 + percent) >= percent * (n + smallest))
            picked = np.flatnonzero(np.repeat(on, BLOCK)[:used])
        ys, at = sets[picked], places[picked]
        ys, at = ys[open_[ys]], at[open_[ys]]
        size = sizes[ys]
        return ys[(size * 100 >= percent * n) & (np.minimum(n - place, size - at) * (100 + percent) >= percent * (n + size))].tolist()


def join_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of distinct hashes."""
    if len(sets) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    sizes = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    _, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ends = np.cumsum(sizes)
    ranked = [np.sort(rank[which[e - n : e]]) for e, n in zip(ends, sizes, strict=True)]
    whole: dict[int, frozenset[int]] = {}
    once = int(rank[counts == 1].max(initial=-1))  # shingles of one set come first in the order
    label = np.arange(len(order))
    lists, forest = Lists(), []
    #: Per set, the overlaps that it has counted, and those of the similar set from which its others are derived.
    counted: list[dict[int, int]] = [{} for _ in order]

    def members(i: int) -> frozenset[int]:
        if i not in whole:
            whole[i] = frozenset(ranked[i].tolist())
        return whole[i]

    for x, tokens in enumerate(ranked):
        n = int(sizes[x])
        prefix = tokens[: n - least_common(n, percent) + 1].tolist()
        open_ = np.ones(x + 1, bool)  # sets neither tested nor connected with this one
        near, apart = None, 0
        for place, token in enumerate(prefix):
            if token <= once:
                continue
            for y in lists.candidates(token, n, place, sizes, open_, percent):
                if not open_[y]:
                    continue
                open_[y] = False
                if near is not None:
                    # what near shares with y, and all that x has and near has not, bound what x shares with y
                    known = counted[near].get(y, counted[y].get(near))
                    if known is not None and (known + apart) * (100 + percent) < percent * (n + sizes[y]):
                        continue
                common = len(members(x) & members(y))
                if common * (100 + percent) >= percent * (n + sizes[y]):
                    forest.append((order[x], order[y]))
                    label[label == label[x]] = label[y]
                    open_ &= label[: x + 1] != label[x]
                    if near is None or n - common < apart:
                        near, apart = y, n - common
                counted[x][y] = common
            lists.add(token, x, place)
    return forest


def _exact(docs: DataFrame, placed: DataFrame, words: int, percent: int, task: int) -> DataFrame:
    """Links (a, b) within groups of candidates."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                token, first = shingles(data, offsets, words)
                body = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(token)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 2)), body], names=["rep", "at", "body"])

    sizes = materialize(placed.groupBy("first").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1"), "sizes")
    # small groups share tasks; a large one is cut into parts
    total = sizes.agg(F.sum("total")).first()[0] or 0
    tasks = max(1, -(-total * 2 // task))
    sizes = sizes.select("first", F.ceil(F.col("total") / F.lit(task // 2)).cast("int").alias("parts"))
    where = placed.join(sizes, "first").withColumn("part", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("first"), F.lit(tasks))).otherwise(F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts"))).cast("int"))
    at = "array<struct<first:long,part:int,parts:int>>"
    where = where.groupBy("rep", F.col("rep_key").alias("_key")).agg(F.collect_list(F.struct("first", "part", "parts")).alias("at"))  # as many as a prefix has shingles
    texts = docs.select(F.col("_id").alias("rep"), "_key", "text").join(where, ["rep", "_key"]).dropDuplicates(["rep", "_key"])
    bodies = texts.select("rep", "text", "at").mapInArrow(lambda x: trimmed(read(x)), f"rep long, at {at}, body binary")
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(-1).cast("long").alias("c"), F.col("part").alias("i"), F.col("part").alias("j")))).otherwise(F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part")), lambda o: F.struct(F.col("first").alias("c"), F.least("part", o).alias("i"), F.greatest("part", o).alias("j"))))
    dealt = bodies.select("rep", "body", F.inline("at")).withColumn("to", F.explode(pairs)).select("to.*", "rep", "first", "body")

    def run(group: pa.Table) -> pa.Table:
        rep, first = group.column("rep").to_numpy(), group.column("first").to_numpy()
        body = group.column("body").to_pylist()
        order = np.lexsort((rep, first))
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        out: list[tuple[int, int]] = []
        for part in np.split(order, cuts):
            out += [(rep[part[a]], rep[part[b]]) for a, b in join_sets([np.frombuffer(body[k], np.uint64) for k in part], percent)]
        return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.groupBy("c", "i", "j").applyInArrow(run, "a long, b long")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, task: int = TASK) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text)."""
    rows = keyed(docs)
    sketches = materialize(rows.select("_id", "_key", "text").transform(lambda d: _with_key(d, words, percent)), "sketches")
    classes = sketches.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("_id", "_key")).alias("r"))
    classes = materialize(classes.select("h1", "h2", "n", F.col("r._id").alias("rep"), F.col("r._key").alias("rep_key")), "classes")
    unique = sketches.select("_id", "_key", "low").join(classes.select(F.col("rep").alias("_id"), F.col("rep_key").alias("_key"), "n"), ["_id", "_key"]).dropDuplicates(["_id", "_key"]).withColumnRenamed("_id", "rep")
    members = _candidates(unique, percent)
    placed = members.join(classes.select("rep", "rep_key", "n"), "rep")
    links = materialize(_exact(rows, placed, words, percent, task).distinct(), "links")
    forget(members)
    # rows that share an id are one vertex
    component = connected_components(links.unionByName(sketches.where("n > 0").join(classes, ["h1", "h2", "n"]).select(F.col("_id").alias("a"), F.col("rep").alias("b")).where("a <> b")))
    out = sketches.select("_id", "n").join(component.withColumnRenamed("node", "_id"), "_id", "left")
    return out.select(F.nullif("_id", F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "_id"), F.lit(NULL_ID)).alias("component_id"))


def _with_key(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Sketches that keep the rows' keys."""
    found = _sketches(docs.select(F.struct("_id", "_key").alias("_id"), "text"), words, percent)
    return found.select("_id._id", "_id._key", "n", "h1", "h2", "low")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


#: The same by plain SQL: all pairs that share a shingle, and what links reach.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * o >= 85 * (na + nb - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT node, min(reach) AS low FROM r GROUP BY node)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id FROM s LEFT JOIN m ON m.node = s.doc_id
"""
