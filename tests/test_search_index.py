"""The persisted index of words against BM25 from the texts."""

import random

import pytest

from tessera.operators import retrieval, search_index

SCHEMA = "id long, text string"


def texts(rng, ids):
    """A word that every text has, frequent and rare ones; null, empty and long texts."""
    out = [(i, " ".join(["The", *(rng.choice(["a", "b", "c", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(30)))])) for i in ids]
    return [(i, None if i % 17 == 0 else "" if i % 19 == 0 else t) for i, t in out]


def by_text(spark, rows, queries):
    got = retrieval.bm25(spark.createDataFrame(rows, SCHEMA), "id", "text", spark.createDataFrame(queries, "query_id int, term string"))
    return {(r.query_id, r.id): pytest.approx(r.score, rel=1e-9) for r in got.collect()}


def by_index(index, queries):
    return {(r.query_id, r.key): r.score for r in index.search(queries).collect()}


def test_index(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = dict(texts(rng, range(60)))
    queries = [(1, "the"), (1, "w3"), (2, "a"), (2, "w7"), (3, "nowhere"), (1, "w3")]
    terms = {1: ["the", "w3"], 2: ["a", "w7"], 3: ["nowhere"]}
    index = search_index.SearchIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.add(spark.createDataFrame(list(rows.items()), SCHEMA), "id", "text", "first")
    want = by_text(spark, rows.items(), queries[:5])
    assert want and by_index(index, terms) == want
    assert by_index(index, spark.createDataFrame(queries, "query_id int, term string")) == want

    # some documents are replaced, others are new, some go; another session opens what there is
    new = dict(texts(rng, [5, 6, 7, 100, 101]))
    rows |= new
    index.add(spark.createDataFrame(list(new.items()), SCHEMA), "id", "text")
    index.delete(spark.createDataFrame([(9,), (100,), (9999,)], "key long"), "second")
    rows = {k: v for k, v in rows.items() if k not in (9, 100)}
    index = search_index.SearchIndex.open(spark, f"file://{tmp_path}/index")
    assert (len(index.segments), index.stamp, index.n_docs) == (2, "second", len(rows))
    want = by_text(spark, rows.items(), queries[:5])
    assert by_index(index, terms) == want

    index.compact()
    assert len(index.segments) == 1 and not index.deletes and by_index(index, terms) == want
    assert by_index(search_index.SearchIndex.open(spark, f"file://{tmp_path}/index"), terms) == want
    assert index.search({}).count() == 0 and index.search({1: ["nowhere"]}).count() == 0
    # many terms are joined
    monkeypatch.setattr(search_index, "FEW", 2)
    assert by_index(index, terms) == want


def test_index_of_a_table(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(1, "x y"), (2, "x")], SCHEMA).write.parquet(at)
    find = lambda: by_index(search_index.index_of(spark.read.parquet(at), "id", "text", at), {1: ["x"]})
    first = find()
    assert set(first) == {(1, 1), (1, 2)}
    made = search_index.index_of(spark.read.parquet(at), "id", "text", at)
    assert search_index.index_of(spark.read.parquet(at), "id", "text", at) is made
    search_index._open.clear()
    assert search_index.index_of(spark.read.parquet(at), "id", "text", at).segments == made.segments  # opened, not built
    spark.createDataFrame([(3, "x x z")], SCHEMA).write.mode("append").parquet(at)
    assert set(find()) == {(1, 1), (1, 2), (1, 3)}


def test_empty_index(spark, tmp_path):
    assert search_index.SearchIndex.open(spark, f"file://{tmp_path}/none") is None
    index = search_index.SearchIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame([], SCHEMA), "id", "text")
    assert index.search({1: ["x"]}).count() == 0
