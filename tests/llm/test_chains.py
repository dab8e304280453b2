"""The two chains: document scores and cut decoding against brute force, and secrets of shapes that no example has."""

import hashlib
import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality, secrets
from tessera.llm.common import text_pieces
from tessera.llm.crf import Model, best_states

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lines_of(text):
    raw = text.encode()
    cut = [raw[a:b] for a, b in itertools.pairwise([0, *(m.end() for m in re.finditer(b"\n", raw) if m.end() < len(raw)), len(raw)])]
    return cut or [b""]


def own_features(line):
    """Shares of character classes, length, and what the words are like, one after another."""
    kinds = [0] * 9
    for b in line:
        c = chr(b)
        k = 8 if b > 127 else 1 if c in string.ascii_lowercase else 2 if c in string.ascii_uppercase else 3 if c in string.digits else 4 if c in "\t\n\x0b\x0c\r " else 5 if c in ".,;:'\"?-()" else 6 if c in "#$%&*!@^~+=<>_/\\{}[]`" else 7 if c == "|" else 0
        kinds[k] += 1
    words = WORD.findall(line)
    n, some, some_words = len(words), max(1, len(line)), max(1, len(words))
    again = sum(a == b for a, b in itertools.pairwise(words))
    shares = [k / some for k in kinds[1:]]
    return [*shares, min(np.log1p(len(line)) / 8, 2), again / some_words, len(set(words)) / some_words, min(len(line) / some_words / 12, 3), sum(w[:1].isupper() and w[0] < 128 for w in words) / some_words, float(kinds[6] + kinds[7] > 0.5 * n), float(kinds[2] > kinds[1]), float(again * 2 > n)]


def plain_score(model, slope, shift, text):
    """The score by going through every path of states."""
    lines = lines_of(text)
    own = [own_features(x) for x in lines]
    nothing = [0.0] * quality.OWN
    x = np.array([[*own[i], *(own[i - 1] if i else nothing), *(own[i + 1] if i + 1 < len(own) else nothing), 1.0] for i in range(len(own))])
    score = x @ model.weights
    good, total = np.zeros(len(lines)), 0.0
    for path in itertools.product((0, 1), repeat=len(lines)):
        p = np.exp(sum(score[i, s] for i, s in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path)))
        total += p
        good += p * np.array(path)
    weight = np.array([max(1, len(x)) for x in lines])
    raw = np.clip((good / total * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(slope * np.log(raw / (1 - raw)) + shift)))


def test_op9_document_score(spark):
    rng = np.random.default_rng(9)
    model = Model(rng.normal(size=(quality.FEATURES, 2)) * 0.7, rng.normal(size=(2, 2)))
    texts = [None, "", "\n", "a\n\nb", "One line.", "x | y | z\n### 12 34\nThe end\n", "é ü\n\n\n", "now now now now\nThen WE went HOME 7 times; (twice)\n\tend", "a\r\nb\x0bc\n" * 3, "q\n" * 9 + "last"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in quality.score(docs, (model, (1.3, -0.2)), "doc_id").collect()}
    assert got == {i: pytest.approx(plain_score(model, 1.3, -0.2, t or ""), rel=1e-4) for i, t in enumerate(texts)}


def test_op9_long_text_and_hot_lines(spark):
    """A text of some megabytes, and one line in most documents."""
    rng = np.random.default_rng(3)
    model = Model(rng.normal(size=(quality.FEATURES, 2)) * 0.5, rng.normal(size=(2, 2)))
    rows = [(0, "All is well here.\n" * 120_000)] + [(i, f"All is well here.\n{i}") for i in range(1, 300)]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), (model, (1.0, 0.0)), "doc_id").collect()}
    assert len(got) == 300 and got[7] == pytest.approx(plain_score(model, 1.0, 0.0, rows[7][1]), rel=1e-4)


def foreign(rng):
    """A text and its secret, in shapes that `secrets.examples` does not make."""
    chars = string.ascii_letters + string.digits
    some = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    words = "the service reads its settings from a file and restarts when they change so please keep it safe and do not share this with anyone outside of our team".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    name = rng.choice(["alpha", "billing", "mailer", "db1", "cache", "orders"])
    s = rng.choice([some(chars, rng.randint(18, 40)), some(chars, 24) + "_" + some(chars, 10), some("0123456789abcdef", rng.randint(20, 31)), some(chars + "+/", 44), "sk_live_" + some(chars, 24), "ghp_" + some(chars, 36), "eyJ" + some(chars, 20) + "." + some(chars, 40) + "." + some(chars, 30)])
    return rng.choice([
        f"# Setup\n\n{say(12)}. Log in as admin with {s} and {say(9)}.\n\n* {say(5)}\n",
        f"services:\n  {name}:\n    image: {name}:2.1\n    environment:\n      - MODE=prod\n      - SIGNING_KEY={s}\n    ports:\n      - 80:80\n",
        f"{say(6)}\nDATABASE_URL=postgres://{name}:{s}@{name}.internal:5432/main\n{say(4)}",
        f'{{"name": "{name}", "retries": 3, "credentials": {{"user": "{name}", "value": "{s}"}}, "debug": false}}',
        f"app.name={name}\napp.port=8080\nmail.smtp.pass={s}\nmail.smtp.host=mail.example.org\n",
        f"$ deploy --env prod --auth={s} --verbose\n{say(7)}",
        f"curl -H 'X-Auth-Key: {s}' https://api.example.com/v1/{name}\n{say(5)}",
        f"{say(8)}\n> can you send me the key?\nsure, here you go: {s}\n> thanks\n{say(6)}",
        f"<server><id>{name}</id><passphrase>{s}</passphrase></server>",
        f"client = Client(\n    '{name}',\n    credential='{s}',\n    timeout=30,\n)\n",
    ]), s


def clean(rng):
    some = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    w = lambda: some(string.ascii_lowercase, rng.randint(3, 9))
    return rng.choice([
        f"services:\n  {w()}:\n    image: registry.example.com/{w()}/{w()}:v{rng.randint(1, 9)}.{rng.randint(0, 20)}\n    mode: {w()}_{w()}_{w()}\n",
        f"def {w()}_{w()}({w()}, {w()}=None):\n    return {w()}.{w()}({w()}[{rng.randint(0, 9)}])\n",
        f"java.lang.IllegalStateException: {w()}\n\tat com.example.{w()}.{w().title()}{w().title()}Factory.get{w().title()}({w().title()}.java:{rng.randint(1, 999)})\n",
        f"{w()},{rng.randint(1, 10**9)},{rng.random():.12f},2024-03-{rng.randint(10, 28)}T{rng.randint(10, 23)}:15:00Z,{w()}@{w()}.example.org",
        f"request id {some('0123456789abcdef', 8)}-{some('0123456789abcdef', 4)}-{some('0123456789abcdef', 4)}-{some('0123456789abcdef', 4)}-{some('0123456789abcdef', 12)} took {rng.randint(1, 999)}ms",
        f"The password must have {rng.randint(8, 20)} characters; the token is sent by mail and the key is on the {w()}.",
        f"tracking number {rng.randint(10**11, 10**12)} and part no. {some(string.ascii_uppercase, 3)}-{rng.randint(1000, 9999)}-{some(string.ascii_uppercase, 2)}",
        f"ISBN 978-3-16-{rng.randint(100000, 999999)}-0, DOI 10.1000/{w()}.{rng.randint(2000, 2024)}.{rng.randint(100, 999)}",
    ])


def test_op8_finds_secrets_of_other_shapes():
    """Secrets that no base pattern finds: nine of ten are found whole, and of clean texts hardly any is marked."""
    chain, rng = secrets.model(), random.Random(21)
    found = asked = 0
    for _ in range(600):
        text, s = foreign(rng)
        at = text.index(s)
        known = secrets.base_spans(text)
        if any(a <= at and at + len(s) <= b for a, _, b in known):
            continue
        asked += 1
        seen = {i for a, _, b in [*known, *secrets.chain_spans(chain, text, known)] for i in range(a, b)}
        found += set(range(at, at + len(s))) <= seen
    assert asked > 300 and found >= 0.9 * asked
    texts = [clean(rng) for _ in range(600)]
    assert sum(bool(secrets.chain_spans(chain, t, secrets.base_spans(t))) for t in texts) <= 12


def test_op8_cut_decoding_is_whole_decoding():
    """Decoding between settled tokens gives the runs of one pass over each text."""
    chain, rng = secrets.model(), random.Random(22)
    texts = [foreign(rng)[0] for _ in range(120)] + [clean(rng) for _ in range(60)] + ["", "x", " ".join(foreign(rng)[0] for _ in range(40))]
    for _, _, data, offsets in text_pieces(pa.array(texts)):
        starts, ends, first = secrets.tokens(data, offsets)
        state = best_states((secrets.features(data, offsets, starts, ends, first) @ chain.weights.astype(np.float32)).astype(float), chain.moves, first)
        want = []
        for d in range(len(first) - 1):
            last = secrets.OUT
            for i in range(first[d], first[d + 1]):
                if state[i] == secrets.BEGIN or state[i] == secrets.INSIDE and last == secrets.OUT:
                    want.append([d, starts[i], ends[i]])
                elif state[i] == secrets.INSIDE:
                    want[-1][2] = ends[i]
                last = state[i]
        got = [list(x) for x in zip(*secrets.chain_runs(chain, data, offsets), strict=True)]
        assert got == want and len(got) > 50


def test_op8_query_gives_whole_matches(spark, tmp_path):
    """Of an assign match the query's span begins at the keyword; where two kinds begin is what sorts them."""
    kinds = (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"))
    texts = [None, "", "é😀 PassWord' : \"abc.defgh\" token=short1", "token=" + "0f" * 16 + " AKIA" + "B" * 12, "secret: AKIA" + "C" * 12, "passwd=secret:token=abcdefgh", "x password\n=abcdefgh1 api_key=" + "a" * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in secrets.op8_secrets(spark, str(tmp_path)).collect():
        found = [[m.span() for m in p.finditer(texts[r.doc_id] or "") if len(m[2 * (k == 0)]) >= (8, 16, 32)[k]] for k, p in enumerate(kinds)]
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, spans in enumerate(found) for a, b in spans))
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*map(len, found), hashlib.sha256(want.encode()).hexdigest())
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))
