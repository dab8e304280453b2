"""Point-in-time features, Merkle manifests and token files on odd rows and empty tables, against brute force."""

import datetime as dt
import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import merkle, packing, point_in_time, token_files

from .conftest import odd_rows
from .test_operators import same

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, at string, rank int"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, block int"
LINES = "sale_id long, line_no int, item_id long, amount double, shipped_at timestamp_ntz, x string"


def shop():
    """A hot client, sale and item; nulls, ties, late arrivals, equal rows and rows long before or after the others."""
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)

    def at(days=30):
        return start + dt.timedelta(seconds=rng.randrange(days * 86400), microseconds=rng.choice([0, 0, 123456]))

    def client():
        return rng.choice([1, 1, 1, 2, 3, None, 4, 5])

    def late(x):
        return None if x is None or rng.random() < 0.05 else x + rng.choice([dt.timedelta(seconds=9), dt.timedelta(hours=5), dt.timedelta(days=rng.randrange(20))])

    sales, clicks, lines = [], [], []
    for i in range(150):
        sold = None if rng.random() < 0.04 else at()
        sales.append((i, client(), "done", rng.choice([None, 1.005, 20.0, -3.25]), sold, late(sold) if sold else start, 1, "x", 1))
    sales += [(150, 1, None, 5.0, start - dt.timedelta(days=400), start, None, None, None), (None, 1, None, 7.0, start + dt.timedelta(days=2), start + dt.timedelta(days=2), None, None, None), (151, 6, None, 7.0, start, start, None, None, None)]
    for i in range(400):
        ts = None if rng.random() < 0.03 else at(32)
        clicks.append((rng.choice([i, i, None]), ts, late(ts) if ts else start, client(), rng.choice(["view", "purchase", None]), rng.choice([None, 0.125, 9.99]), rng.choice(["{}", None]), 1))
    same_time = start + dt.timedelta(days=9)
    clicks += [(1000 + i, same_time, same_time, 1, "view", 1.0, None, i) for i in range(5)]
    clicks += [*clicks[:60], clicks[7]]
    for _ in range(700):
        shipped = None if rng.random() < 0.05 else start + dt.timedelta(days=rng.randrange(40))
        lines.append((rng.choice([None, 7, 7, 7, 9999, rng.randrange(150), rng.randrange(150), rng.randrange(150)]), 1, rng.choice([None, 1, 1, rng.randrange(12)]), rng.choice([None, 2.5, 0.01]), shipped, "x"))
    return sales, clicks, [*lines, *lines[:30]]


def brute(sales, clicks, lines):
    us = lambda x: None if x is None else (x - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    cents = lambda x: 0 if x is None else int(np.floor(100 * x + 0.5))
    day, delay = 86_400_000_000, 240 * 60_000_000
    of = {}
    for r in lines:
        of.setdefault(r[0], []).append(r)
    for sale_id, client, _, _, sold, *_ in sales:
        if sale_id is None or client is None or sold is None:
            continue
        t = us(sold) + zlib.crc32(str(sale_id).encode()) % 259200 * 1_000_000
        label = any(s[1] == client and s[4] is not None and t < us(s[4]) <= t + 7 * day for s in sales)
        for d in (2, 14):
            seen = [c for c in set(clicks) if c[3] == client and c[1] and c[2] and t - d * day < us(c[1]) <= t and us(c[2]) + delay <= t]
            bought = [s for s in sales if s[1] == client and s[4] and s[5] and t - d * day < us(s[4]) <= t and us(s[5]) + delay <= t]
            got = [x for s in bought if s[0] is not None for x in of.get(s[0], []) if x[4] and us(x[4]) <= t]
            last = max(((us(c[1]), c[0] is not None, c[0]) for c in seen), default=(0, 0, None), key=lambda x: (x[0], x[1], x[2] or 0))[2]
            yield sale_id, d, t, label, len(seen), sum(c[4] == "purchase" for c in seen), sum(cents(c[5]) for c in seen), last, len(bought), sum(cents(s[3]) for s in bought), len(got), len({x[2] for x in got} - {None}), sum(cents(x[3]) for x in got)


def test_op11(spark):
    sales, clicks, lines = shop()
    frames = spark.createDataFrame(sales, SALES), spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(lines, LINES)
    got = point_in_time.features(*frames)
    assert got.columns == ["sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents"]
    want = list(brute(sales, clicks, lines))
    assert any(w[10] > 20 for w in want) and any(w[7] is None for w in want)
    same([tuple(r) for r in got.collect()], want)


def test_op11_empty(spark):
    sales, clicks, lines = shop()
    empty = [spark.createDataFrame([], s) for s in (SALES, CLICKS, LINES)]
    assert point_in_time.features(*empty).count() == 0
    got = point_in_time.features(spark.createDataFrame(sales, SALES), empty[1], empty[2]).collect()
    same([tuple(r) for r in got], list(brute(sales, [], [])))


def test_op11_bounded_groups(spark):
    """A hot client's rows meet in blocks of about the square root of its probes."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 1, "x", 1.0, start + dt.timedelta(minutes=i), start + dt.timedelta(minutes=i), 1, "", 1) for i in range(2500)]
    got = point_in_time.features(spark.createDataFrame(rows, SALES), spark.createDataFrame([], CLICKS), spark.createDataFrame([], LINES))
    assert got.count() == 5000
    assert got.where("d = 14").agg({"n_sales": "max"}).first()[0] == 2500


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The levels of a tree."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def way(levels, i):
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        yield i % 3, run[: i % 3] + run[i % 3 + 1 :]
        i //= 3


def leaf(doc_id, source, lang, n_chars, text):
    return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text))


def manifest(rows):
    by = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        now = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            now = text.replace("\n", "")
        by.setdefault(source, []).append((doc_id is None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, now), doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in sources}
    over = tree([trees[s][-1][0] for s in sources])
    root = over[-1][0]
    for k, s in enumerate(sources):
        for i, (_, _, digest, now, doc_id) in enumerate(sorted(by[s])):
            steps = [*way(trees[s], i), *way(over, k)]
            folded = now
            for place, others in steps:
                folded = h([*others[:place], folded, *others[place:]])
            yield doc_id, digest, trees[s][-1][0], root, h(x for _, others in steps for x in others), folded, folded == root


def tampered(docs):
    from pyspark.sql import functions as F

    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return docs.withColumn("tampered", F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def test_op12(spark, odd, empty):
    got = [tuple(r) for r in merkle.proven(tampered(odd)).collect()]
    want = list(manifest(odd_rows()))
    assert {w[-1] for w in want} == {True, False}
    same(got, want)
    one = [r for r in odd_rows() if r[0] == 9]
    same([tuple(r) for r in merkle.proven(tampered(odd.where("doc_id = 9"))).collect()], list(manifest(one)))
    assert merkle.proven(tampered(empty)).count() == 0


@pytest.mark.parametrize("kw", [{}, {"shard": 2000}, {"most": 3}])
def test_op13(spark, odd, tmp_path, kw):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write(odd, folder, path, **kw)
    got = sorted([tuple(r) for r in token_files.read(manifest, folder).collect()], key=lambda r: r[1])
    want = {}
    for r in odd_rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    assert [r[0] for r in got] == sorted((r[0] for r in odd_rows()), key=lambda x: (x is None, x))
    place = 0
    for doc_id, start, n, crc in got:
        assert start == place and (n, crc) in [w[:2] for w in want[doc_id]]
        place += n
    same([r[2:] for r in got], [w[:2] for v in want.values() for w in v])
    wanted = spark.createDataFrame([(0,), (8,), (10,), (10,), (777,), (None,)], "doc_id long")
    found = token_files.lookup(manifest, folder, wanted).collect()
    same([(r.doc_id, r.ids) for r in found], [(i, w[2]) for i in (0, 8, 10) for w in want[i]])


def test_op13_files(spark, odd, empty, tmp_path):
    path = packing.default_tokenizer()
    folder = f"file://{tmp_path}/none"
    manifest = token_files.write(empty, folder, path)
    assert manifest.count() == 0 and token_files.read(manifest, folder).count() == 0
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write(odd, folder, path)
    (tmp_path / "ids" / "dictionary").write_bytes(b"another")
    with pytest.raises(Exception, match="another format or dictionary|of another"):
        token_files.read(manifest, folder).collect()
