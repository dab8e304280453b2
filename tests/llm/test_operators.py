"""The ten operators on odd rows and on empty tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, fingerprint, jaccard_join, mixing, packing, quality, secrets, sharding, stages, substring_dedup, suffix_dedup

from .conftest import odd_rows

ROWS = [(r[0], r[1] or "") for r in odd_rows()]
INF = float("inf")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(got, want):
    assert Counter(map(str, got)) == Counter(map(str, want))


def covered(n, starts, width):
    gone = bytearray(n)
    for s in starts:
        gone[s : s + width] = b"\1" * width
    return gone


def test_op1(odd, empty):
    words = [WORD.findall(t) for _, t in ROWS]
    least = {}
    for (i, _), w in zip(ROWS, words, strict=True):
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            least[k] = min(least.get(k, INF), INF if i is None else i)
    want = []
    for (i, _), w in zip(ROWS, words, strict=True):
        gone = covered(len(w), [s for s in range(len(w) - 49) if least[tuple(w[s : s + 50])] < (INF if i is None else i)], 50)
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    for batches in (1, 3):
        got = substring_dedup.substring_dedup(odd, batches=batches).collect()
        same([tuple(r)[:4] for r in got], want)
        assert all(sum(b - a for a, b in r.removed) == r.n_removed for r in got)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_op1_merges_and_compacts(spark, odd, tmp_path, monkeypatch):
    """Runs are merged in their stored order, without a sort, and compacted within the query."""
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index")
    index.append(odd.where("doc_id < 15"))
    index.append(odd.where("doc_id >= 15"), odd.where("doc_id < 15"))
    with substring_dedup._stored_order(spark):
        plan = index._merged(spark.table(index.runs[1]), index.runs[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan
    merged = []
    compact = substring_dedup.FingerprintIndex.compact

    def counted(self, force=False):
        before = len(self.runs)
        compact(self, force)
        merged.append((before, len(self.runs)))

    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", counted)
    substring_dedup.substring_dedup(odd).count()
    assert len(merged) >= 4 and (3, 1) in merged


@pytest.mark.parametrize("kw", [{}, {"shard_bytes": 3000}])
def test_op2(odd, empty, kw):
    texts = [t.encode() for _, t in ROWS]
    seen = Counter(b[s : s + 400] for b in texts for s in range(len(b) - 399))
    want = []
    for (i, _), b in zip(ROWS, texts, strict=True):
        gone = covered(len(b), [s for s in range(len(b) - 399) if seen[b[s : s + 400]] > 1], 400)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = suffix_dedup.suffix_dedup(odd, **kw).select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)).collect()
    same([tuple(r) for r in got], want)
    if not kw:
        assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_op3(odd, empty):
    got = mixing.mix(odd).collect()
    sizes = Counter()
    for r in odd_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        for s in over or list(open_):
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
            left -= target[s]
            open_.discard(s)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(ROWS) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    key = lambda rows: sorted(map(str, rows))
    assert key(mixing.mix(odd.repartition(2)).collect()) == key(got)
    assert mixing.mix(empty).count() == 0


def test_op4(odd, empty, spark):
    got = fingerprint.fingerprint_versions(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    # ids that occur once, whose next row is sure
    once = [(i, t) for i, t in ROWS if i is not None and i not in (9, 10)]
    texts = dict(once)
    for r in got:
        if r.doc_id in texts and r.doc_id + 1 in texts:
            t, nxt = texts[r.doc_id], texts[r.doc_id + 1]
            half = len(t) // 2
            assert r.n_chars == len(t)
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {}
    for r in got:
        if r.doc_id in texts:
            assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    one = fingerprint.fingerprint_versions(odd.where("doc_id = 4")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"two wtwo ").hexdigest()
    assert fingerprint.fingerprint_versions(empty).count() == 0


def test_op5(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 8)).tolist()
    x[20:60] = [(np.array(x[0]) + 0.05 * rng.normal(size=8)).tolist() for _ in range(40)]
    x[60:90] = [x[5]] * 30
    rows = [(i, v, "q") for i, v in enumerate(x)] + [(200, None, "q"), (201, [], "q"), (202, [0.0] * 8, "q"), (203, [1.0, None] * 4, "q"), (204, [float("nan")] * 8, "q"), (205, [1.0, 2.0], "q"), (206, [2.0, 4.0], "q"), (None, [9.0] + [0.0] * 7, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, _id string")
    m = np.array(x, np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = (m @ m.T >= 0.9) & ~np.eye(150, dtype=bool)
    label = embedding_dedup._local_labels(150, *np.nonzero(hit))
    for kw in ({}, {"cell": 20, "block": 16}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df, **kw).collect()}
        assert {i: got[i] for i in range(150)} == {i: (int(hit[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(150)}
        assert all(got[i] == (0, i, True) for i in range(200, 205)) and got[205][:2] == got[206][:2] == (1, 205) and got[None] == (0, None, True)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_op5_compares_all_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 64))
    x[:500] = rng.normal(size=64) + 0.28 * rng.normal(size=(500, 64))
    m = x.astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = (m @ m.T >= 0.9) & ~np.eye(900, dtype=bool)
    label = embedding_dedup._local_labels(900, *np.nonzero(hit))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df, cell=5, block=16).collect()}
    assert hit.sum() > 100_000 and got == {i: (int(hit[i].sum()), int(label[i])) for i in range(900)}


def test_op6(odd, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.default_tokenizer()
    tok = tokenizers.Tokenizer.from_file(path)
    want = []
    for i, t in ROWS:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want += [(i, a // 512, a, len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes())) for a in range(0, len(ids), 512)]
    got = packing.pack(odd.repartition(5), path, capacity=512, fan=2).collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.15 * sum(r.length for r in got) / 512 + 1
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("kw", [{}, {"task": 900}, {"words": 5, "percent": 80}])
def test_op7(odd, empty, kw):
    k, percent = kw.get("words", 4), kw.get("percent", 85)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in ROWS:
        w = WORD.findall(t.translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    node = [INF if i is None else i for i, _ in ROWS]
    label = {n: n for n in node}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = label[node[i]], label[node[j]]
                label = {n: min(x, y) if v in (x, y) else v for n, v in label.items()}
    got = jaccard_join.jaccard_join(odd, **kw).collect()
    same([tuple(r) for r in got], [(i, len(s), None if label[n] == INF else label[n]) for (i, _), s, n in zip(ROWS, sets, node, strict=True)])
    if not kw:
        assert jaccard_join.jaccard_join(empty).count() == 0


def plain_spans(text):
    """The base spans, letter by letter instead of by patterns."""
    found = []
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    word = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    i = 0
    while i < len(text):
        j = next((i + len(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key") if fold.startswith(w, i)), None)
        if j is not None:
            j += text[j : j + 1] in ('"', "'") and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] in (":", "="):
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                k = j
                while k < len(text) and text[k] in word:
                    k += 1
                if k > j:
                    if k - j >= 8:
                        found.append(("assign", j, k))
                    i = k
                    continue
        i += 1
    for kind, lead, chars, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), ("hex", "", set("0123456789abcdef"), 32)):
        i = 0
        while i < len(text):
            k = i + len(lead)
            while text.startswith(lead, i) and k < len(text) and text[k] in chars:
                k += 1
            if k > i + len(lead):
                if k - i >= least:
                    found.append((kind, i, k))
                i = k
            else:
                i += 1
    return sorted(found, key=lambda f: (f[1], ("assign", "access", "hex").index(f[0])))


def test_op8(spark, odd, empty):
    texts = [None, "", "é password = \"abc.defgh\" x", "Token:short1 TOKEN: longenough9", "AKIA" + "B" * 12 + " " + "AKIA" + "B" * 11, "f" * 32 + "g" + "0" * 31, "ſecret = abcdefgh1 password=a\npasswd: zzzzzzzz", "export DEPLOY_KEY=Zx81kLmN90pQrStUvWxYz12345678 end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secrets.scan(df, "doc_id").collect():
        want = plain_spans(texts[r.doc_id] or "")
        assert [tuple(s) for s in r.spans if s.kind != "chain"] == want
        got = {r.doc_id: [(s.kind, (texts[r.doc_id] or "")[s.start : s.end]) for s in r.spans]}
        if r.doc_id == 2:
            assert got[2] == [("assign", "abc.defgh")]
        if r.doc_id == 3:
            assert got[3] == [("assign", "longenough9")]
        if r.doc_id == 4:
            assert [k for k, _ in got[4]] == ["access"] or ("access", "AKIA" + "B" * 12) in got[4]
        if r.doc_id == 7:
            assert got[7] == [("chain", "DEPLOY_KEY=Zx81kLmN90pQrStUvWxYz12345678".split("=")[1])]
    masked = {r.doc_id: r.text for r in secrets.mask(df).collect()}
    assert masked[2] == "é password = \"[SECRET]\" x" and masked[0] is None and masked[5] == "[SECRET]g" + "0" * 31
    assert secrets.scan(odd, "doc_id", "_id").count() == len(ROWS) and secrets.scan(empty, "doc_id").count() == 0


def test_op9(odd, empty, labels, spark):
    fitted = quality.fit(odd, labels, sample=20)
    got = quality.score(odd, fitted, "doc_id", "_id").collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    copies = [r.score for r in got if r.doc_id == 10]
    assert len(copies) == 4 and len(set(copies)) == 2  # equal texts have equal scores
    prose = [(i, f"The quick brown fox number {i} went home.\nIt was late and dark there.", "x") for i in range(60)]
    junk = [(100 + i, f"win### cash$$$ {i}%%% now### " * 5 + "\nNow now now now now now", "x") for i in range(60)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i < 100)) for i in (*range(60), *range(100, 160))], "doc_id long, quality int")
    p = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, marks), "doc_id").collect()}
    held = [i for i in p if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((p[i] >= quality.ACCEPT) == (i < 100) for i in held)
    assert quality.fit(empty, labels) is None and quality.fit(odd, labels.limit(0)) is None
    assert quality.score(empty, None, "doc_id").count() == 0
    assert {r.score for r in quality.score(odd, None, "doc_id").collect()} == {0.5}


def test_op10(odd, empty):
    for limit, kw in ((5000, {"width": 3}), (1 << 20, {}), (700, {"width": 30, "step": 9})):
        got = sharding.shard(odd, limit=limit, **kw).collect()
        same([(r.doc_id, r.n_bytes) for r in got], [(i, len(t.encode())) for i, t in ROWS])
        total, docs = Counter(), Counter()
        for r in got:
            total[r.shard] += r.n_bytes
            docs[r.shard] += 1
        assert all(total[r.shard] == r.shard_bytes for r in got)
        assert all(n <= limit or docs[s] == 1 for s, n in total.items())
    assert sharding.shard(empty).count() == 0
    plan = sharding.shard(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_op7_compares_every_text_of_an_id(spark):
    rng = np.random.default_rng(3)
    texts = [[f"t{k}w{n}" for n in rng.integers(0, 10**6, 200)] for k in range(6)]
    near = lambda k: " ".join([*texts[k][:-1], "other"])
    full = [" ".join(t) for t in texts]
    rows = [(5, full[0]), (5, full[1]), (3, near(0)), (2, near(1)), (None, full[2]), (None, full[3]), (None, full[4]), (7, near(2)), (8, near(3)), (9, near(4)), (11, full[5])]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 2, 3: 2, 2: 2, None: 7, 7: 7, 8: 7, 9: 7, 11: 11}


def same_component(sets, percent):
    """The least number reachable by links, for sets in order."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def shingle_set(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_pipeline_stages(spark, odd, empty, labels, tmp_path):
    at = str(tmp_path)
    labels.write.parquet(f"{at}/labels.parquet")
    for stage in (stages.good_documents, stages.one_of_each_group, stages.without_secrets, stages.mixed):
        assert stage(spark, odd, at).columns == list(stages.COLUMNS)
        assert stage(spark, empty, at).count() == 0
    assert stages.packed(spark, empty, at).count() == 0
    # one row of each group of near copies among the different rows, whatever their ids; an id's own text counts as it
    kept = Counter((r.doc_id, r.text) for r in stages.one_of_each_group(spark, odd, at).collect())
    assert max(kept.values()) == 1
    rows = sorted({(i, t) for i, t, *_ in odd_rows()}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    label = same_component([shingle_set(t, stages.SHINGLE) for _, t in rows], stages.NEAR)
    of = dict(zip(rows, label, strict=True))
    assert sorted(of[k] for k in kept) == sorted(set(label))
    for c in set(label):
        own = [r[0] for r in rows if of[r] == c]
        unique = [i for i in own if i is not None and [r[0] for r in rows].count(i) == 1]
        if unique and min(unique) == min(i for i in own if i is not None):
            assert min(unique) in [k[0] for k in kept if of[k] == c]
    words = Counter()
    for r in mixing.mix(odd).collect():
        words[r.source] += r.taken
    out = Counter()
    for r in stages.mixed(spark, odd, at).collect():
        out[r.source] += len(WORD.findall(r.text or ""))
    assert out == +words


def test_mixed_stage_equal_rows(spark):
    """Rows equal in all columns take together what the mix gives them, no more."""
    rows = [(1, "a b c d e f g h i j " * 10, "en", "s0", 200)] * 6 + [(10 + i, f"w{i} " * 100, "en", "s0", 300) for i in range(4)] + [(20, "x y", "en", None, 3)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    got = Counter()
    for r in stages.mixed(spark, docs, "").collect():
        got[r.source] += len(WORD.findall(r.text))
    assert got == want and want["s0"] > 1000


def test_pipeline_run(spark, tmp_path, monkeypatch):
    """All stages from end to end: good documents stay, copies go, secrets are masked, the sequences hold what is left."""
    import corpus_pipeline

    good = [(i, f"The quiet river {i} ran past the old mill number {i}.\nPeople of town {i * 7} spoke of it, and the day {i * 3} was calm.", "en", f"s{i % 2}", 0) for i in range(40)]
    junk = [(100 + i, f"win### cash$$$ {i}%%% now### " * 5, "en", "s0", 0) for i in range(40)]
    extra = [(200, good[3][1], "en", "s1", 0), (201, None, "en", None, None), (202, good[5][1] + "\npassword = abcdefgh1234", "en", "s1", 0)]
    spark.createDataFrame(good + junk + extra, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in (*range(40), *range(100, 140))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & set(range(100, 140)) and 200 not in ids and len(ids & set(range(40))) >= 38
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert all("abcdefgh1234" not in (r.text or "") for r in docs.collect())
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.fixture(scope="module")
def twisted(spark):
    """Words and passages that polynomial hashes modulo a power of two take for equal."""
    x, y = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    same_words = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{same_words} {x}"), (2, f"{same_words} {y}"), (3, x), (4, y)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_op1_and_op2_tell_twisted_texts_apart(twisted):
    rows, df = twisted
    assert [r.n_removed for r in substring_dedup.substring_dedup(df).collect()] == [0] * 4
    seen = Counter(t[s : s + 400] for _, t in rows for s in range(len(t) - 399))
    want = {i: sum(covered(len(t), [s for s in range(len(t) - 399) if seen[t[s : s + 400]] > 1], 400)) for i, t in rows}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(df).collect()} == want


def test_op4_and_op7_tell_twisted_texts_apart(twisted, spark):
    _, df = twisted
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(df.where("doc_id > 2")).collect()} == {3: 3, 4: 4}
    got = {r.doc_id: r for r in fingerprint.fingerprint_versions(df.where("doc_id > 2")).collect()}
    assert got[3].fingerprint != got[4].fingerprint and got[3].near_next == 0


def test_op1_index_goes_on_after_a_restart(spark, tmp_path):
    """Five batches, two compactions and an index that is opened again: the same as all at once."""
    rng = np.random.default_rng(6)
    passages = [" ".join(f"p{k}x{n}" for n in rng.integers(0, 999, 80)) for k in range(4)]
    rows = [(i, " ".join(f"w{n}" for n in rng.integers(0, 10**6, 40)) + " " + passages[i % 4][: None if i % 3 else 400] + f" tail{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", fanout=2, buckets=4)
    got, compactions = {}, 0
    for k in range(5):
        part, earlier = df.where(f"doc_id >= {8 * k} AND doc_id < {8 * k + 8}"), df.where(f"doc_id < {8 * k}")
        for r in index.append(part, earlier).collect():
            got[r.doc_id] = (r.n_removed, r.kept_text)
        if k in (1, 3):
            index.compact(force=True)
            compactions += len(index.runs) == 1
        if k == 2:
            for name in index.runs:
                spark.sql(f"DROP TABLE {name}")  # as in a new session's catalog
            index = substring_dedup.FingerprintIndex.open(spark, f"file://{tmp_path}/index")
    assert compactions == 2 and len(index.runs) == 2
    assert got == {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df).collect()}
    assert sum(n for n, _ in got.values()) > 1000
    fps = index.rows().select("fp").distinct().limit(3)
    assert index.lookup(fps).select("fp").distinct().count() == 3


def test_long_texts_and_hot_keys(spark):
    """A text beyond a kernel's piece, and groups of copies that are most of the rows."""
    rng = np.random.default_rng(8)
    words = [f"v{n}" for n in rng.integers(0, 10**7, 330_000)]
    long = " ".join(words)
    assert len(long) > 2 << 20
    copy, near = " ".join(f"c{n}" for n in range(120)), " ".join(f"n{n}" for n in range(200))
    rows = [(0, long), (1, " ".join(words[1000:1200]))] + [(10 + i, copy) for i in range(150)] + [(200 + i, f"{near} x{i}") for i in range(150)]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string").repartition(4)
    one = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df).collect()}
    assert one[1] == 200 and one[0] == 0 and one[10] == 0 and {one[i] for i in range(11, 160)} == {120} and {one[i] for i in range(201, 350)} == {200}
    two = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(df).collect()}
    assert two[1] == len(rows[1][1]) and two[0] >= two[1] and {two[i] for i in range(10, 160)} == {len(copy)} and min(two[i] for i in range(200, 350)) >= len(near)
    seven = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(df, task=20_000).collect()}
    assert {seven[i] for i in range(10, 160)} == {10} and {seven[i] for i in range(200, 350)} == {200} and seven[0] == 0 and seven[1] == 1
    mixed = mixing.mix(df).collect()
    assert abs(sum(r.taken for r in mixed) - 1.5 * sum(r.size for r in mixed)) <= 1
    four = {r.doc_id: r for r in fingerprint.fingerprint_versions(df).collect()}
    assert four[0].n_chars == len(long) and len({four[i].fingerprint for i in range(10, 160)}) == 1
    shards = sharding.shard(df, limit=1500).collect()
    assert len(shards) == len(rows) and all(r.shard_bytes <= 1500 or r.doc_id < 2 for r in shards)
    assert all(not r.spans for r in secrets.scan(df, "doc_id").collect())
    same_rows = spark.createDataFrame([(None, "abc " * 50)] * 90, "doc_id long, text string").repartition(5)
    paged = sharding.shard(same_rows, limit=1000).collect()
    assert len(paged) == 90 and max(r.shard_bytes for r in paged) <= 1000


def test_op3_takes_the_least_keys_first(spark):
    """The order of the draws against a plain sort, by other keys than the operator's own."""
    rows = [(i, "w " * (1 + i % 7), "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight = F.lit(1.0) + F.col("doc_id") % 5
    got = mixing.mix(df, weight=weight, share=0.5, cycle=(1,)).collect()
    draws = df.select("doc_id", F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 52)).alias("h")).collect()
    key = {r.doc_id: -np.log((r.h + 0.5) / 2.0**52) / (1 + r.doc_id % 5) for r in draws}
    for source in "ab":
        mine = sorted((r for r in got if r.source == source), key=lambda r: key[r.doc_id])
        left = int(mine[0].target)
        for r in mine:
            assert r.taken == min(r.size, max(0, left))
            left -= r.size


def plain_paragraphs(text):
    """Runs of words up to a line's or sentence's end, eight at most, as a multiset."""
    out, run = [], []
    for m in WORD.finditer(text):
        run.append(m[0])
        if text[m.end() : m.end() + 1] == "\n" or m[0][-1] in ".!?" or len(run) == 8:
            out.append(tuple(run))
            run = []
    return Counter(out + ([tuple(run)] if run else []))


def test_op4_likeness(spark):
    rng = np.random.default_rng(9)
    base = [f"word{n}" + (".", "")[int(n % 5 > 0)] for n in rng.integers(0, 500, 400)]
    rows = []
    for i in range(12):
        w = list(base)
        for k in rng.integers(0, 400, 3 * i):
            w[k] = f"new{k}x{i}"
        rows.append((i, ("\n" if i % 2 else " ").join(w[: 400 - 20 * i])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in fingerprint.fingerprint_versions(df).collect():
        text, after = rows[r.doc_id][1], rows[(r.doc_id + 1) % 12][1]
        half = len(text) // 2
        for other, got in ((text[: len(text) - half] + after[:half], r.near_edited), (after, r.near_next)):
            a, b = plain_paragraphs(text), plain_paragraphs(other)
            assert got == pytest.approx(1 - sum(((a - b) + (b - a)).values()) / (a.total() + b.total()))


def test_op4_ranges_cut_a_hot_id(spark, monkeypatch):
    """Rows without an id are dealt to many ranges, and every row finds the next one across their borders."""
    monkeypatch.setattr(fingerprint, "SAMPLE", 500)
    rows = [(None if i % 3 else i, f"text {i % 700} of many. and {i % 500} more\n") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = fingerprint.following(fingerprint.keyed(docs), 16).collect()
    assert len({r["_bucket"] for r in dealt}) >= 12
    assert max(Counter(r["_bucket"] for r in dealt).values()) < len(rows) / 5
    out = fingerprint.fingerprint_versions(docs).collect()
    assert len(out) == len(rows) and Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
