"""Folds over ordered groups against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import series


def test_ema(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), i, None if i % 40 == 0 else rng.random()) for i in range(3000)]
    rng.shuffle(rows)
    want: dict = {}
    for g, _, v in sorted(rows, key=lambda r: r[1]):
        if v is not None:
            want[g] = 0.1 * v + 0.9 * want.get(g, 0.5)
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(7)
    got = {r.g: r.ema for r in series.ema(df, ["g"], [F.col("i")], "v", 0.5).collect()}
    assert got == {g: pytest.approx(v, rel=1e-12) for g, v in want.items()}
    assert series.ema(df.where("false"), ["g"], [F.col("i")], "v", 0.5).count() == 0


def test_budgeted(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), i, rng.choice([0, 1, 5, 30, None])) for i in range(900)]
    want, used = set(), {}
    for g, i, n in rows:
        used[g] = used.get(g, 0) + (n or 0)
        if used[g] <= 700:
            want.add((g, i, used[g]))
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(5)
    got = series.budgeted(df, ["g"], [F.col("i")], F.col("n"), 700)
    assert got.columns == ["g", "i", "n", "used"] and {(r.g, r.i, r.used) for r in got.collect()} == want
