"""The nearest kept vector against all pairs: hot cells, odd vectors, ties."""

import numpy as np
import pytest

from tessera.operators import nearest

SCHEMA = "k long, v array<float>"


@pytest.mark.parametrize(("low", "block"), [(0.6, 4096), (0.6, 40), (-1.0, 4096), (0.95, 64)])
def test_nearest(spark, low, block):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8)
    points = [hot + rng.normal(size=8) * 0.2 if i % 2 else rng.normal(size=8) for i in range(900)]
    rows = [(i, [float(c) for c in p]) for i, p in enumerate(points)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, 2.0]), (2004, rows[5][1]), (2005, rows[5][1]), (2007, rows[8][1])]
    kept, asked = rows[300:] + odd, rows[:300] + odd
    x = lambda rs: {k: np.array(v, np.float32).astype(float) for k, v in rs if v is not None and len(v) == 8 and np.isfinite(v).all() and any(v)}
    want, keep = {}, x(kept)
    for k, q in x(asked).items():
        c = {j: q @ p / (np.linalg.norm(q) * np.linalg.norm(p)) for j, p in keep.items()}
        j = min(c, key=lambda j: (-round(c[j], 9), j))
        if c[j] >= low:
            want[k] = (j, pytest.approx(c[j], abs=1e-9))
    got = {r.asked: (r.kept, r.cosine) for r in nearest.nearest(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(kept, SCHEMA), "k", "v", low, 30, block).collect()}
    assert len(want) > 100 and got == want
    draft = {r.asked for r in nearest.drafts(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(kept, SCHEMA), "k", "v").collect()}
    if low == 0.6:
        assert draft == {k for k, (_, c) in want.items() if c.expected < 0.85} and draft


def test_nothing_kept(spark):
    some, none = spark.createDataFrame([(1, [1.0])], SCHEMA), spark.createDataFrame([], SCHEMA)
    for asked, kept in ((some, none), (none, some), (some, spark.createDataFrame([(1, [0.0])], SCHEMA))):
        assert nearest.nearest(asked, kept, "k", "v", 0.5).count() == 0
