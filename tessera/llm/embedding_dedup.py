"""Operator 5: near-duplicate vectors by spherical k-means cells.

Equal vectors are one class.  Centroids are fitted on a sample of classes of at
most `sample` rows.  Classes are laid in order of their nearest centroid and of
their angle to it, and cut into tiles of about `WIDE` blocks.  Two cells can hold
a link only if their centroids lie within the cells' radii and arccos(cosine); a
vector is sent to the tiles of such cells alone.  Each pair of tiles that is left
is a task of its own, so a hot cell spreads over many: blocked products in
double precision, links counted per vector, connections kept as one edge per
vector to its least local relative.  No pair of vectors is emitted.

No pair is missed: cells and order only save work.  Within a task a strip of
vectors is multiplied with those whose angle to the strip's mean lies within the
strip's own angles, widened by arccos(cosine); by the triangle inequality the
others link with none of it.  Vectors without clusters have wide cells and are
compared all with all, which costs the square of their number.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; rows
that share a vec_id are one vertex with the links of all; null ids come last
and are returned as null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, materialize, table, trimmed
from .components import connected_components

COSINE, CELL, BLOCK, SAMPLE, MOST_CELLS = 0.9, 1000, 1024, 50_000, 8192
#: Blocks of a tile, shells that the angles to a centroid are cut into, and ranges of tiles that a cell is sent to at most (near ones are joined).
WIDE, SHELLS, RANGES = 8, 16, 64


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows x; the same rows give the same centroids."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        best = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c, -1, 1))


def _assign(classes: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """dim, cell (nearest centroid) and shell (of the angle to it) of every class."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids)  # MOST_CELLS centroids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                c = shared.value.get(int(dim))
                cell, angle = np.zeros(len(part), np.int64), np.zeros(len(part))
                if c is not None:
                    near = _matrix(part.column(2)) @ c.T
                    cell, angle = near.argmax(1), np.arccos(np.clip(near.max(1), -1, 1))
                shell = (angle * (SHELLS / np.pi)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in (np.full(len(part), dim, np.int64), cell, shell, angle))], names=["_id", "copies", "vec", "dim", "cell", "shell", "angle"])

    return classes.mapInArrow(lambda x: trimmed(run(x)), "_id long, copies long, vec array<double>, dim long, cell long, shell long, angle double")


def reachable(centroids: np.ndarray, radii: np.ndarray, first: np.ndarray, last: np.ndarray, cosine: float, ranges: int = RANGES) -> list[list[tuple[int, int]]]:
    """Per cell, the ranges of tiles (first to last of each cell) that can hold a link of the cell's vectors."""
    reach = np.arccos(min(max(cosine, -1.0), 1.0)) + 1e-6
    out = []
    for lo in range(0, len(centroids), 256):
        angle = np.arccos(np.clip(centroids[lo : lo + 256] @ centroids.T, -1, 1))
        for k, near in enumerate(angle <= radii[lo : lo + 256, None] + radii[None] + reach):
            near[lo + k] = True
            a, b = first[near], last[near]
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            gap = a[1:] - b[:-1] - 1
            least = max(1, int(np.sort(gap)[-ranges])) if len(gap) >= ranges else 1
            cut = np.flatnonzero(gap >= least)[: ranges - 1] if least > 1 else np.flatnonzero(gap >= 1)
            out.append(list(zip(a[np.append(0, cut + 1)].tolist(), b[np.append(cut, len(b) - 1)].tolist(), strict=True)))
    return out


def _tiles(placed: DataFrame, centroids: dict[int, np.ndarray], size: int, cosine: float) -> DataFrame:
    """placed with `own`, the tile of each class among those of its dimension, and `others`, the ranges of tiles to meet."""
    spark = placed.sparkSession
    counts = placed.groupBy("dim", "cell", "shell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).orderBy("dim", "cell", "shell").collect()  # SHELLS a cell at most
    groups, cells = [], []
    for dim, rows in itertools.groupby(counts, lambda r: r.dim):
        rows = list(rows)
        before = np.cumsum([0] + [r.n for r in rows])
        tiles = -(-int(before[-1]) // size)
        tile = lambda at: min(int(at) // size, tiles - 1)  # noqa: B023, E731
        groups += [(dim, r.cell, r.shell, int(at), r.n, tiles) for r, at in zip(rows, before[:-1], strict=True)]
        of: dict[int, list[float]] = {}
        for r, a, b in zip(rows, before[:-1], before[1:], strict=True):
            first, _, radius = of.get(r.cell, (tile(a), 0, 0.0))
            of[r.cell] = [first, tile(b), max(radius, r.angle)]
        names = sorted(of)
        first, last, radii = (np.array([of[c][k] for c in names]) for k in range(3))
        if dim in centroids:
            cells += [(dim, c, x) for c, x in zip(names, reachable(centroids[dim][names], radii, first.astype(int), last.astype(int), cosine), strict=True)]
        else:
            cells += [(dim, c, [(0, tiles - 1)]) for c in names]
    groups = spark.createDataFrame(groups, "dim long, cell long, shell long, before long, n long, tiles long")
    cells = spark.createDataFrame(cells, "dim long, cell long, others array<struct<a:int,b:int>>")  # MOST_CELLS rows of RANGES ranges at most
    place = F.col("before") + F.col("n") * F.pmod(F.xxhash64("_id", "vec"), F.lit(1 << 20)) / F.lit(1 << 20)
    own = F.least(F.floor(place / F.lit(size)), F.col("tiles") - 1).cast("int")
    return placed.join(F.broadcast(groups), ["dim", "cell", "shell"]).withColumn("own", own).join(F.broadcast(cells), ["dim", "cell"]).drop("before", "n", "angle")


def _local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable over the edges a - b, for n vertices."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, cells: np.ndarray, cell: int, side: np.ndarray, diagonal: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, least local relative, links) of the vectors that link within a pair of blocks."""
    order = np.argsort(side, kind="stable")
    ids, copies, x, cells, side = ids[order], copies[order], x[order], cells[order], side[order]
    split = 0 if diagonal else int(np.searchsorted(side, side[-1]))
    links = np.zeros(len(ids), np.int64)
    label = np.arange(len(ids))
    reach = np.arccos(min(max(cosine, -1.0), 1.0)) + 1e-6
    for lo in range(0, len(ids) if diagonal else split, 256):
        hi = min(lo + 256, len(ids) if diagonal else split)
        rest = np.arange(lo if diagonal else split, len(ids))
        mean = x[lo:hi].mean(axis=0)
        if (norm := np.linalg.norm(mean)) > 0:
            # what lies farther from the strip's angles links with none of it
            strip, far = _angles(x[lo:hi], mean / norm), _angles(x[rest[0] :] if len(rest) else x[:0], mean / norm)
            rest = rest[(far >= strip.min() - reach) & (far <= strip.max() + reach)]
        a, b = np.nonzero(x[lo:hi] @ x[rest].T >= cosine)
        a, b = a + lo, rest[b]
        if diagonal:
            a, b = a[a < b], b[a < b]
        # the first cell that both share is the one that counts the pair
        both = (cells[a][:, :, None] == cells[b][:, None, :]).any(2)
        mine = np.where(both.any(1), cells[a, both.argmax(1)], -1) == cell
        a, b = a[mine], b[mine]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        if len(a):
            label = _local_labels(len(ids), np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, label]))
    least = np.full(len(ids), NULL_ID)
    np.minimum.at(least, label, ids)
    hit = np.flatnonzero(links)
    return ids[hit], least[label[hit]], links[hit]


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("_id"), v.alias("vec"))
    sound = F.coalesce((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vec", F.when(sound, F.col("vec")))
    classes = materialize(rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("_id").alias("_id"), F.count("*").alias("copies")).select("_id", "copies", "vec"), "classes")
    centroids: dict[int, np.ndarray] = {}
    for dim, n in classes.groupBy(F.size("vec").alias("dim")).count().where(F.col("count") > cell).orderBy("dim").collect():  # a row a length
        k = min(MOST_CELLS, -(-n // cell))
        if k > 1:
            got = classes.where(F.size("vec") == dim).orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(min(sample, max(2000, 32 * k))).select("vec").toArrow()
            centroids[dim] = spherical_kmeans(_matrix(got.column("vec")), k)
    placed = materialize(_assign(classes, centroids), "placed")
    dealt = _tiles(placed, centroids, WIDE * block, cosine)
    dealt = dealt.withColumn("other", F.explode(F.expr("flatten(transform(others, r -> sequence(r.a, r.b)))"))).select("dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "_id", "copies", "vec", "cell", "shell")

    def run(group: pa.Table) -> pa.Table:
        i, j, dim = (group.column(k)[0].as_py() for k in ("i", "j", "dim"))
        group = group.take(pa.array(np.lexsort((group.column("shell").to_numpy(), group.column("cell").to_numpy()))))
        one = np.full((len(group), 1), dim)
        found = block_links(group.column("_id").to_numpy(), group.column("copies").to_numpy(), _matrix(group.column("vec")), one, dim, group.column("own").to_numpy(), i == j, cosine)
        return pa.Table.from_arrays([pa.array(x) for x in found], names=["a", "b", "links"])

    linked = materialize(dealt.groupBy("dim", "i", "j").applyInArrow(run, "a long, b long, links long"), "linked")
    total = linked.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(linked.select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.select(F.col("vec").alias("own_vec"), F.col("_id").alias("rep"), "copies").join(total, "rep", "left").join(component, "rep", "left")
    known = materialize(known.select("own_vec", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    out = rows.join(known, F.col("vec") == F.col("own_vec"), "left").select("vec_id", "_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_id").alias("component"))
    return out.select("vec_id", "n_links", F.nullif("component", F.lit(NULL_ID)).alias("component_id"), (F.col("component") == F.col("_id")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


#: The same by plain SQL over all pairs.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT a AS node, b AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT node, min(reach) AS least FROM r GROUP BY node)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN m ON m.node = vec_id
"""
