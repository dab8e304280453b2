"""The nearest of many kept vectors for each of many asked ones: cells around centroids, exact products within cells.

A centroid is a kept vector; each kept vector belongs to the cell of the nearest
one, and a cell's radius is the angle of the furthest of them.  An asked vector
goes to every cell that can hold a vector within the angle that still counts, so
nothing is missed.  Cells are cut into blocks of kept and of asked vectors, and a
task multiplies one block by another, some rows at a time.  Vectors are sent as
they came and brought to length one where they are multiplied; a vector that
every cell can hold one for is sent once for each block of kept ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settled

#: Centroids at most, bytes of them at most, and vectors of a block.
CELLS, BYTES, BLOCK = 1024, 16 << 20, 16384
#: Vectors that Python takes or gives back at once, and bytes of a product.
ROWS, PRODUCT = 2048, 32 << 20
#: What rounding may take from an angle.
_SLACK = 1e-6


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows of length one; null, zero and broken vectors are rows of zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0))
    out = np.zeros((len(lists), dim))
    good = np.flatnonzero(sizes == dim) if dim else np.zeros(0, np.int64)
    if len(good):
        flat = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float)
        out[good] = flat.reshape(len(good), dim)
    with np.errstate(all="ignore"):
        length = np.sqrt((out * out).sum(axis=1))
        ok = np.isfinite(length) & (length > 0)
        out[ok] /= length[ok, None]
    out[~ok] = 0
    return out


def _fit(x: np.ndarray, dim: int) -> np.ndarray:
    """Rows of another dimension are of no use here."""
    return x if x.shape[1] == dim else np.zeros((len(x), dim))


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def nearest(asked: DataFrame, kept: DataFrame, key: str, vector: str, low: float, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(asked, kept, cosine): of each asked row the kept row of the largest cosine, the least key of equals, if that is `low` or more."""
    spark = kept.sparkSession
    first = kept.where(f"`{vector}` IS NOT NULL").select(vector).first()
    kind, shape = (kept.schema[c].dataType.simpleString() for c in (key, vector))
    schema = f"asked {asked.schema[key].dataType.simpleString()}, kept {kind}, cosine double"
    if first is None:
        return spark.createDataFrame([], schema)
    dim = len(first[0])
    # a vector is sent to each cell at most, so there are no more of them than blocks of kept vectors
    many = kept.count()
    wanted = max(1, min(cells, BYTES // (8 * dim), int(many**0.5), -(-many // block)))
    # the rows of least hashes, at most `CELLS` of them and `BYTES` together
    sample = kept.where(f"`{vector}` IS NOT NULL").select(vector, F.xxhash64(key).alias("h")).orderBy("h").limit(wanted).toArrow()
    centroids = _fit(unit(sample.column(0)), dim)
    centroids = centroids[np.abs(centroids).sum(axis=1) > 0]
    if not len(centroids):
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            x = _fit(unit(batch.column(1)), dim)
            live = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
            angle = _angles(x[live], held.value)
            cell = angle.argmin(axis=1) if len(live) else np.zeros(0, np.int64)
            took = batch.take(pa.array(live))
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(live)), cell])], names=["kept", "x", "cell", "angle"])

    inside = settled(kept.select(F.col(key).alias("kept"), vector).mapInArrow(placed, f"kept {kind}, x {shape}, cell int, angle double"))
    sizes = inside.groupBy("cell").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    radius = np.full(len(centroids), -np.inf)
    for r in sizes.collect():  # a row a cell
        radius[r.cell] = r.radius
    reach = float(np.arccos(low)) + _SLACK

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            x = _fit(unit(batch.column(1)), dim)
            near = (_angles(x, held.value) <= radius[None] + reach) & (np.abs(x).sum(axis=1) > 0)[:, None]
            row, cell = np.nonzero(near)
            for at in range(0, len(row), ROWS):
                took = batch.take(pa.array(row[at : at + ROWS]))
                yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(cell[at : at + ROWS].astype(np.int32))], names=["asked", "q", "cell"])

    ask_kind, ask_shape = (asked.schema[c].dataType.simpleString() for c in (key, vector))
    visits = settled(asked.select(F.col(key).alias("asked"), vector).mapInArrow(sent, f"asked {ask_kind}, q {ask_shape}, cell int"))
    groups = visits.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("askers"))
    plan = F.broadcast(sizes.join(groups, "cell").select("cell", "blocks", "askers"))  # a row a cell
    left = visits.join(plan, "cell").withColumn("a", F.pmod(F.xxhash64("asked"), F.col("askers")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = inside.join(plan, "cell").withColumn("b", F.pmod(F.xxhash64("kept"), F.col("blocks")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)))

    def product(asks: pa.Table, keeps: pa.Table) -> pa.Table:
        q, x = unit(asks.column("q")), unit(keeps.column("x"))
        if not len(q) or not len(x):
            return pa.table({"asked": asks.column("asked").slice(0, 0), "kept": keeps.column("kept").slice(0, 0), "cosine": pa.array([], pa.float64())})
        order = np.argsort(keeps.column("kept").to_numpy(zero_copy_only=False), kind="stable")  # the least key of equals comes first
        x = x[order].T
        best, top = np.zeros(len(q), np.int64), np.full(len(q), -np.inf)
        for at in range(0, len(q), rows := max(1, PRODUCT // (8 * x.shape[1]))):
            cosine = q[at : at + rows] @ x
            top[at : at + rows] = cosine.max(axis=1)
            best[at : at + rows] = np.round(cosine, 12, out=cosine).argmax(axis=1)
        hit = np.flatnonzero(top >= low)
        return pa.table({"asked": asks.column("asked").take(pa.array(hit)), "kept": keeps.column("kept").take(pa.array(order[best[hit]])), "cosine": pa.array(top[hit])})

    found = left.select("cell", "a", "b", "asked", "q").groupBy("cell", "a", "b").cogroup(right.select("cell", "a", "b", "kept", "x").groupBy("cell", "a", "b")).applyInArrow(product, schema)
    best = F.min_by(F.struct("kept", "cosine"), F.struct((-F.round("cosine", 12)).alias("d"), "kept"))
    return found.groupBy("asked").agg(best.alias("m")).select("asked", "m.kept", "m.cosine")


def drafts(asked: DataFrame, kept: DataFrame, key: str, vector: str, low: float = 0.6, high: float = 0.85) -> DataFrame:
    """(asked, kept, cosine) of the questions whose nearest kept one is alike enough to start from, but not the same."""
    return nearest(asked, kept, key, vector, low).where(F.col("cosine") < high)
