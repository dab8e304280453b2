"""Places of runs of words, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import grams


def plain(sources, tail, width, left, most):
    for key, text in sources:
        w = (text or "").split()
        for i in range(len(w) - width - left + 1):
            if w[i : i + width] == tail:
                return key, i + width, w[i + width : i + width + most]
    return None


@pytest.mark.parametrize(("few", "left", "most"), [(1_000_000, 8, 100), (0, 8, 100), (1_000_000, 0, 3)])
def test_echo(spark, monkeypatch, few, left, most):
    """With the index looked up in place and joined; a hot passage stands in half of the sources."""
    monkeypatch.setattr(grams, "FEW", few)
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    sources = [(i, rng.choice(["\n", " ", "\x0c\t "]).join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(60)]
    sources = [(i, f"{t} {passage} x{i}" if i % 2 else t) for i, t in sources] + [(60, None), (61, ""), (62, "p0 p1 p2 p3 p4 p5")]
    recent = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for k in range(150)] + [(200, "said p3 p4 p5 p6 p7"), (201, "p25 p26 p27 p28 p29"), (202, None), (203, "p7 p6 p5 p4 p3"), (204, " p3  p4\np5 p6 p7 ")]
    got = grams.echo(spark.createDataFrame(sources, "id long, text string"), "id", "text", spark.createDataFrame(recent, "k int, said string"), "k", "said", left=left, most=most).collect()
    want = {k: found for k, said in recent if len((said or "").split()) >= 5 and (found := plain(sources, said.split()[-5:], 5, left, most))}
    assert len(want) > 20 and {r.k: (r.source, r.position, r.next) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_shared_runs(spark, monkeypatch, few):
    monkeypatch.setattr(grams, "FEW", few)
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("ABab") for _ in range(60))) for i in range(20)] + [(20, None), (21, "a b")]
    items = [(i, " ".join(rng.choice("ab") for _ in range(30))) for i in range(6)]
    cut = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)}
    want = {(i, j, n) for i, a in texts for j, b in items if (n := len(cut(a) & cut(b))) >= 8}
    got = grams.shared_runs(spark.createDataFrame(texts, "d long, text string"), "d", "text", spark.createDataFrame(items, "i long, text string"), "i", "text")
    assert want and {(r.d, r.i, r.shared) for r in got.collect()} == want


def test_windows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b"), (3, None)], "k int, t string")
    assert [(r.place, r.said) for r in grams.windows(df, "k", "t").orderBy(F.col("place")).collect()] == [(0, "a b c d e"), (1, "b c d e f")]
