"""Memory of the nearest vectors: what a task holds at once has a bound, however many cells a vector visits."""

import numpy as np
import pyarrow as pa

from tessera.operators import nearest

SCHEMA = "k long, v array<float>"


def test_pieces():
    got = list(nearest.pieces(iter([pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (5, 0, 2)]), 2))
    assert [b.num_rows for b in got] == [2, 2, 1, 2] and [x for b in got for x in b.column(0).to_pylist()] == [0, 1, 2, 3, 4, 0, 1]


def test_small_batches_and_products(spark, monkeypatch):
    """Every vector visits every cell, so visits outnumber the vectors; batches and products are cut, with the same result."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    x[::7] = x[0]  # ties
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], SCHEMA).repartition(2)
    asked, kept = df.where("k % 3 = 0"), df.where("k % 3 <> 0")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    keys = [i for i in range(700) if i % 3]
    cosines = u[::3] @ u[keys].T
    want = {3 * i: keys[int(np.round(c, 12).argmax())] for i, c in enumerate(cosines)}
    monkeypatch.setattr(nearest, "ROWS", 16)
    monkeypatch.setattr(nearest, "PRODUCT", 8 * 40 * 5)
    seen = []
    settled = nearest.settled
    monkeypatch.setattr(nearest, "settled", lambda rows: seen.append(settled(rows)) or seen[-1])
    got = {r.asked: r.kept for r in nearest.nearest(asked, kept, "k", "v", -1.0, 20, 40).collect()}
    assert got == want
    inside, visits = seen
    assert inside.schema["x"].dataType.simpleString() == visits.schema["q"].dataType.simpleString() == "array<float>"
    assert 5 * asked.count() < visits.count() <= asked.count() * -(-kept.count() // 40)
