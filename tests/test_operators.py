"""Small cases of the store, graph, history, vector, scan and source operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.operators import assist, curate, graph, history, scan, store, vectors
from tessera.sources import readers, sinks
from tessera.streaming import watch


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = store.upsert(old, new, ["k"])
    assert {(r.k, r.v, r.change) for r in once.collect()} == {(1, "a", "kept"), (2, "c", "updated"), (3, "d", "added")}
    again = store.upsert(once.drop("change"), new, ["k"])
    assert {r.change for r in again.collect()} == {"kept", "unchanged"}


def test_reconcile_adds_up(spark):
    b, n = (spark.createDataFrame([(x,) for x in v], "f string") for v in ("abc", "bcd"))
    got = {r.f: r.state for r in store.reconcile(b, n, "f").collect()}
    assert got == {"a": "resolved", "b": "unchanged", "c": "unchanged", "d": "added"}


def test_stable_ids(spark):
    found = spark.createDataFrame([("x",), ("y",), ("z",)], "fingerprint string")
    known = spark.createDataFrame([("y", "VULN-2023-0007")], "fingerprint string, id string")
    got = {r.fingerprint: r.id for r in store.stable_ids(found, known, "VULN", 2025, [F.col("fingerprint")]).collect()}
    assert got == {"x": "VULN-2025-0008", "y": "VULN-2023-0007", "z": "VULN-2025-0009"}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 4)], "src int, dst int")
    one = spark.createDataFrame([(1,)], "node int")
    assert {(r.node, r.depth) for r in graph.distances(e, one, 5).collect()} == {(1, 0), (2, 1), (4, 1), (3, 2)}
    p = graph.paths(e, one, spark.createDataFrame([(4,), (3,)], "node int"), 4).collect()
    assert {(r.end, tuple(r.path)) for r in p} == {(4, (1, 4)), (3, (1, 2, 3))}


def test_vectors(spark):
    df = spark.createDataFrame([(1, 1.0, [0.0, 2.0]), (1, 3.0, [4.0, 2.0]), (2, 0.0, [5.0, 5.0])], "g int, w double, v array<double>")
    got = {(r.g, r.pos): r.x for r in vectors.fedavg(df, "g", "v", "w").collect()}
    assert got == {(1, 0): 3.0, (1, 1): 2.0, (2, 0): 5.0, (2, 1): 5.0}
    assert {(r.g, r.pos): r.x for r in vectors.coordinate_median(df, "g", "v").collect()}[(1, 0)] == 2.0
    many = spark.createDataFrame([(1, [float(x)]) for x in [*range(1, 10), 1000]], "g int, v array<double>")
    assert vectors.trimmed_mean(many, "g", "v").first().x == 5.5
    n = df.select(vectors.norm(vectors.clip_l2(F.col("v"), 1.0)).alias("n")).collect()
    assert all(r.n <= 1 + 1e-9 for r in n)
    again = [df.select(vectors.noised(F.col("v"), 1.0, 1.0, 1e-5, F.col("g"))).collect() for _ in range(2)]
    assert again[0] == again[1]


def test_history(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "commit int, file string")
    r = history.co_evolution(files).first()
    assert (r.a, r.b, r.shared, r.only_a, r.only_b, r.jaccard, r.strength) == ("a", "b", 2, 1, 0, 0.667, "moderate")
    counts = spark.createDataFrame([("f", "x", 8), ("f", "y", 2)], "file string, author string, commits int")
    assert history.bus_factor(counts, ["file"]).first().bus_factor == 1


def test_golden_corpus(spark):
    """Every planted class is found, on its line, and clean files stay clean."""
    bad = {"sql": ("q = 1\ndb.execute(f'select {q}')\n", "sql_injection", 2), "cmd": ("os.system(x)\n", "command_injection", 1), "pickle": ("pickle.loads(b)\n", "unsafe_deserialization", 1), "md5": ("hashlib.md5(b)\n", "weak_crypto", 1), "secret": ("password = 'abcdefghij1234'\n", "hardcoded_secret", 1), "tmp": ("tempfile.mktemp()\n", "insecure_temp", 1)}
    clean = {"c1": "# os.system(x)\nx = 'eval(y)'\n", "c2": "db.execute('select 1', [q])\n", "c3": ""}
    files = spark.createDataFrame([(k, v[0]) for k, v in bad.items()] + list(clean.items()), "path string, text string")
    got = {(r.path, r["class"], r.line) for r in scan.findings(files, "path", "text").collect()}
    assert got == {(k, v[1], v[2]) for k, v in bad.items()}


def test_blanking_keeps_lengths():
    s = "x = 'a\\'b'  # c\ny = \"\"\"q\nr\"\"\"\n"
    b = scan.blank_literals(s)
    assert len(b) == len(s) and b.count("\n") == s.count("\n") and "c" not in b and "q" not in b


def test_sources():
    hunks = readers.parse_diff("--- a/x\n+++ b/x\n@@ -1,2 +3 @@\n-a\n+b\n+c\n")
    assert hunks == [("x", 1, 2, 3, 1, 2, 1)]
    # only a line feed ends a line
    assert readers.parse_diff("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\x0cb\n-c\u2028\n+d\n") == [("x", 1, 2, 1, 2, 1, 1)]
    assert readers.parse_diff("+++ b/x\r\n@@ -1 +1 @@\r\n-a\r\n+b\r\n") == [("x", 1, 1, 1, 1, 1, 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nbroken\n{"x": 2}\n')
    assert sorted(r.x for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    (tmp_path / "t" / ".git").mkdir(parents=True)
    (tmp_path / "t" / "m.py").write_text("x")
    (tmp_path / "t" / "n.bin").write_text("x")
    (tmp_path / "t" / ".git" / "k.py").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in readers.source_tree(spark, str(tmp_path / "t")).collect()] == ["m.py"]


def test_text(spark):
    df = spark.createDataFrame([("getUserName snake_case",)], "t string")
    got = df.select(text.identifier_tokens(F.col("t")).alias("x")).first().x
    assert {"getusername", "get", "user", "name", "snake_case", "snake", "case"} <= set(got)
    long = "word " * 15 + "a b c d e f g h i j " + "spam " * 9
    cut = spark.createDataFrame([(long,)], "t string").select(text.truncate_repetition(F.col("t")).alias("x")).first().x
    assert len(cut) < len(long) or cut == long
    c = spark.createDataFrame([("i think so",), ("yes, the answer is 4",)], "t string").select(scoring.text_confidence(F.col("t")).alias("c")).collect()
    assert [r.c for r in c] == [0.4, 0.55]


def test_curate(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r")], "conv_id int, turn int, role string, text string")
    p = curate.pairs(turns)
    assert [(r.instruction, r.response) for r in p.collect()] == [("q", "a")]
    m = p.select(curate.parse_chatml(curate.chatml()).alias("m")).first().m
    assert [(x.role, x.content) for x in m] == [("user", "q"), ("assistant", "a")]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "e" if i % 2 else "f") for i in range(40)], "i int, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = watch.activity(stream, "10 minutes").writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.start, r.kind, r.n) for r in df.collect())
    assert key(spark.table("activity")) == key(watch.activity(rows, "10 minutes"))


def test_watcher(spark, tmp_path):
    at, seen = str(tmp_path / "snap"), str(tmp_path / "in")
    sinks.save_snapshot(spark.createDataFrame([(1, "a")], "k int, v string"), at)
    spark.createDataFrame([(1, "b"), (2, "c"), (3, None)], "k int, v string").write.parquet(seen)
    w = watch.Watcher(at, "k", sound=F.col("v").isNotNull())
    w.start(spark.readStream.schema("k int, v string").parquet(seen), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [w.status()[k] for k in ("added", "updated", "errors", "batches")] == [1, 1, 1, 1]
    w.pause()
    assert w.status()["paused"] and not w.status()["running"]
    spark.createDataFrame([(4, "d")], "k int, v string").write.mode("append").parquet(seen)
    w.resume().awaitTermination()
    assert {tuple(r) for r in w.snapshot(spark).collect()} == {(1, "b"), (2, "c"), (4, "d")}
    w.stop()
    with pytest.raises(RuntimeError):
        w.resume()
    with pytest.raises(Exception):  # a failure of another kind is not swallowed: the batch stays to be applied
        w.apply(spark.createDataFrame([(1,)], "k int"), 9)


def test_debounce_matches_a_fold(spark):
    rng = np.random.default_rng(5)
    rows = [(w, float(x)) for w in range(3) for x in np.round(np.cumsum(rng.exponential(0.7 if w else 0.05, 400)), 2)]
    df = spark.createDataFrame(rows, "watcher int, t double").select("watcher", F.timestamp_seconds(F.col("t")).alias("ts"))
    got = sorted((r.watcher, r.ts.timestamp(), r.batch) for r in watch.debounce(df, 2.0, 0.2).collect())
    want = []
    for w in range(3):
        opened, n = None, 0
        for r in sorted(r.ts.timestamp() for r in df.where(F.col("watcher") == w).collect()):
            if opened is None or r - opened >= 1.8:
                opened, n = r, n + 1
            want.append((w, r, n))
    assert [g[::2] for g in got] == [g[::2] for g in sorted(want)]
    assert watch.debounce(df.limit(0)).count() == 0


def test_stable_ids_beyond_four_digits(spark):
    found = spark.range(12_000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("fingerprint"))
    known = spark.createDataFrame([("k", "VULN-2024-0003")], "fingerprint string, id string")
    ids = [r.id for r in store.stable_ids(found.repartition(5), known, "VULN", 2025, [F.col("fingerprint")]).orderBy("fingerprint").collect()]
    assert ids == [f"VULN-2025-{n:04d}" for n in range(4, 12_004)]


def test_diff_lines_that_look_like_headers():
    text = "--- a/x.sql\n+++ b/x.sql\n@@ -1,3 +1,3 @@\n keep\n--- old comment\n-- two\n+++ new comment\n++ two\n@@ -9 +9,2 @@\n-a\n+b\n+c\n\\ No newline at end of file\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-q\n+r\n"
    assert readers.parse_diff(text) == [("x.sql", 1, 3, 1, 3, 2, 2), ("x.sql", 9, 1, 9, 2, 2, 1), ("y", 1, 1, 1, 1, 1, 1)]
    assert readers.parse_diff(None) == []


def test_function_range_and_ignore_patterns(spark, tmp_path):
    source = "class A:\n    class B:\n        def f(self):\n            def g():\n                pass\n            return g\n\nasync def f():\n    pass\n"
    assert readers.function_range(source, "A.B.f") == (3, 6) and readers.function_range(source, "f") == (8, 9)
    assert readers.function_range(source, "A") is None and readers.function_range("def (", "f") is None
    (tmp_path / ".gitignore").write_text("# c\n\n/build/\n!keep\n*.log\nout\n")
    assert readers.ignore_patterns(spark, str(tmp_path)) == ["build", ".log", "out"]
    assert readers.ignore_patterns(spark, str(tmp_path / "none")) == []


def test_new_scan_rules(spark):
    code = ["if os.path.exists(p):\n    f = open(p)\n", "yaml.load(x)\n", "yaml.load(x, Loader=yaml.SafeLoader)\n", "k = 'sk-abcdefghijklmnopqrstuv'\n", "commands.getoutput(c)\n", "httpx.get(base + path)\n"]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(code)], "path string, text string")
    got = {(r.path, r["class"]) for r in scan.findings(df, "path", "text").collect()}
    assert {("0", "race_condition"), ("1", "unsafe_deserialization"), ("3", "hardcoded_secret"), ("4", "command_injection"), ("5", "ssrf")} <= got
    assert ("2", "unsafe_deserialization") not in got


def test_stale_index(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "vec array<float>, language string, text string")
    check = lambda df: assist.stale(df, 2, "# chunk:").first().stale
    assert check(rows(([1.0], "python", "# chunk: a"))) and check(rows(([1.0, 2.0], "python", "b")))
    assert not check(rows(([1.0, 2.0], "python", "# chunk: a"), ([1.0, 2.0], "go", "b"))) and not check(rows(([1.0, 2.0], "go", "b"))) and not check(rows().limit(0))


def test_hdc_encode_takes_all_words(spark):
    book = np.random.RandomState(42).randint(0, 2, (256, 1024))
    long = [f"w{k % 37}x{k}" for k in range(300)]
    texts = [" ".join(long), " ".join([*long[:100], *long[:200]]), " ".join(long[:64]), "one", ""]
    want = []
    for text in texts:
        votes = np.zeros(1024, int)
        for i, word in enumerate(text.split()):
            bits = sum(np.roll(book[c], j) for j, c in enumerate(word.encode())) % 2
            votes += np.roll(2 * bits - 1, i)
        want.append(np.packbits(votes > 0).tobytes())
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string")
    got = {r.turn: bytes(r.bits) for r in vectors.hypervectors(df, ["conv_id", "turn"], "text", dim=1024).collect()}
    assert got == dict(enumerate(want))
