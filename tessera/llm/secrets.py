"""Operator 8: secret scans by patterns and a linear-chain conditional random field.

Three base patterns are always reported.  Beside them a chain tags every token
of a text as the begin or inside of a secret, or outside, from the token's
shape, its neighbours and features of the whole file, decoded by Viterbi.
Features and scores are computed for all tokens by array operations.  Where a
token's score for outside exceeds the others by more than any moves can make
up, its state is known; the path between two such tokens is decoded apart, with
the same result as one pass over the text (`crf.settled`).

The chain is trained on the driver from generated snippets (see `examples`),
the same ones each time; it sees no row of the input.

Defined cases: null is an empty text, without spans; offsets count code
points, ends are exclusive; of an assign match the span is the secret itself
(group 2), or the whole match where that is asked for, as the query does; rows that share an id are scanned each; a chain span that meets a
base span is not reported again; extra columns are ignored.  A kernel holds one
text at a time, at about 150 bytes a byte.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_pieces, trimmed
from .crf import Model, best_states, settled, train

#: Kind, pattern, group that is the secret, its least length.  Fixed values.
BASE = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
KINDS = ("assign", "access", "hex", "chain")
#: A text that this does not match has no base span.
_MAYBE = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
_HEX = re.compile(r"[0-9a-f]{32,}")

OUT, BEGIN, INSIDE = 0, 1, 2
#: Bytes of text whose features are computed at once; a text is never cut.
PIECE = 1 << 18
#: Words (or the parts of names) that announce a secret.
KEYWORDS = ("access", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "key", "pass", "passphrase", "passwd", "password", "private", "pwd", "secret", "signature", "token")
#: First letters of tokens that some services issue.
PREFIXES = ("AKIA", "AIza", "eyJ", "ghp_", "gho_", "glpat-", "sk-", "sk_", "xox")
_HIGH = 0x80


def _eights(words: tuple[str, ...]) -> np.ndarray:
    """The first eight bytes of words as numbers, shorter ones filled with zeros."""
    return np.array([int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "little") for w in words], np.uint64)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LOWER, _UPPER, _DIGIT = (_table(x) for x in (string.ascii_lowercase, string.ascii_uppercase, string.digits))
_HEXED, _JOINT, _QUOTE, _SETS, _LINE = (_table(x) for x in ("0123456789abcdef", "+/_.-", "\"'`", "=:", "\n"))
_TOKEN = _LOWER | _UPPER | _DIGIT | _JOINT
_TOKEN[_HIGH:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a piece (runs of letters, digits and `+/_.-`), and the first token of each text."""
    inside = _TOKEN[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[1:] = True, ~inside
    edge[offsets] = True
    starts = np.flatnonzero(inside & edge[:-1])
    edge[-1], edge[:-1] = True, ~inside
    edge[offsets] = True
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _before(x: np.ndarray, head: np.ndarray, by: int = 1) -> np.ndarray:
    """x of the token `by` places before, False beyond the text's first token."""
    out = np.zeros_like(x)
    out[by:] = x[:-by] if len(x) > by else x[:0]
    out[np.arange(len(x)) - by < head] = False
    return out


def features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of features for every token: shape, neighbours, file."""
    size = ends - starts

    def count(mask: np.ndarray, a: np.ndarray = starts, b: np.ndarray = ends) -> np.ndarray:
        upto = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=upto[1:])
        return upto[b] - upto[a]

    lower, upper, digit = (count(t[data]) for t in (_LOWER, _UPPER, _DIGIT))
    joint, hexed, high = count(_JOINT[data]), count(_HEXED[data]), count(data >= _HIGH)
    # how often the kind of character changes within the token
    kind = (_LOWER.astype(np.uint8) + 2 * _UPPER + 3 * _DIGIT)[data]
    turn = np.zeros(len(data), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turns = count(turn, np.minimum(starts + 1, ends))
    # bytes as numbers: eight from the start, and eight lower-case ones from the token's last part
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    lead = eight[starts]
    joints = np.flatnonzero(_JOINT[data])
    last = np.searchsorted(joints, ends) - 1
    part = np.maximum(starts, np.where(last >= 0, joints[np.maximum(last, 0)] + 1, 0)) if len(joints) else starts
    length = np.minimum(ends - part, 8)
    mask = np.where(length >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(length, 7)).astype(np.uint64)) - np.uint64(1))
    folded = np.ndarray((len(data) + 1,), "<u8", np.concatenate([_FOLD[data], np.zeros(8, np.uint8)]).data, strides=(1,))
    keyword = np.isin(folded[part] & mask, _eights(KEYWORDS)) & (length > 2)
    issued = np.zeros(len(starts), bool)
    for p in PREFIXES:
        bits = np.uint64((1 << 8 * len(p)) - 1)
        issued |= (lead & bits) == _eights((p,))[0]
    head = first[:-1].repeat(np.diff(first))
    gap = np.empty(len(starts), np.int64)  # where the bytes since the token before begin
    gap[:1], gap[1:] = offsets[0], ends[:-1]
    gap = np.maximum(gap, offsets[:-1].repeat(np.diff(first)))
    sets, line = count(_SETS[data], gap, starts) > 0, count(_LINE[data], gap, starts) > 0
    previous = np.where(starts > gap, data[np.maximum(starts - 1, 0)], 0)
    after = np.where(ends < offsets[1:].repeat(np.diff(first)), padded[ends], 0)
    announced = [_before(keyword, head, k) for k in (1, 2, 3)]
    shape = size >= 12
    solid = size - joint
    mixed = (digit > 0) & (lower + upper > 0)
    texts = np.diff(first)
    settings = np.add.reduceat(np.append(_SETS[data] | (data == 61), False), offsets[:-1]) * 60 > np.diff(offsets) if len(data) else np.zeros(len(texts), bool)
    spoken = np.bincount(np.repeat(np.arange(len(texts)), texts), keyword, len(texts)) > 0
    columns = [
        np.ones(len(size)), np.log2(size) / 6, size >= 8, shape, size >= 16, size >= 20, size >= 24, size >= 32, size >= 40,
        digit > 0, mixed, mixed & shape, digit == size, digit + joint == size, digit * 10 > 3 * size, digit * 10 < size,
        (lower > 0) & (upper > 0) & mixed, upper + digit == size, (upper + digit == size) & mixed & shape, hexed == size, (hexed == size) & mixed & shape,
        turns * 4 > size, turns * 8 > size, (turns * 6 > solid) & shape & mixed, joint == 0, joint * 6 > size, high > 0,
        (size == 36) & (joint == 4) & (hexed == 32), data[starts] == 47, data[starts] == 46,
        sets, sets & shape, np.isin(previous, list(b"\"'`")), previous == 64, after == 64, line,
        keyword, *announced, announced[0] & sets, (announced[0] | announced[1]) & mixed & shape,
        issued, issued & shape, spoken.repeat(texts), settings.repeat(texts), _before(mixed & shape, head) & mixed & shape,
    ]
    return np.stack(columns, axis=1).astype(np.float32) if len(size) else np.zeros((0, len(columns)), np.float32)


def chain_runs(chain: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) in bytes of the secrets that the chain finds in a piece."""
    starts, ends, first = tokens(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    score = features(data, offsets, starts, ends, first) @ chain.weights.astype(np.float32)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    open_ = ~settled(score, chain.moves, OUT)
    # stretches of open tokens, with the known token on either side
    near = open_.copy()
    near[:-1] |= open_[1:] & (text[1:] == text[:-1])
    near[1:] |= open_[:-1] & (text[1:] == text[:-1])
    rows = np.flatnonzero(near)
    if not len(rows):
        return none, none, none
    cut = np.concatenate([[True], (np.diff(rows) > 1) | (text[rows[1:]] != text[rows[:-1]])])
    state = np.zeros(len(starts), np.int8)
    state[rows] = best_states(score[rows].astype(float), chain.moves, np.append(np.flatnonzero(cut), len(rows)))
    hit = np.flatnonzero(state != OUT)
    if not len(hit):
        return none, none, none
    new = np.ones(len(hit), bool)
    new[1:] = (state[hit[1:]] == BEGIN) | (np.diff(hit) > 1) | (text[hit[1:]] != text[hit[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(hit)) - 1
    return text[hit[head]], starts[hit[head]], ends[hit[tail]]


def examples(count: int = 1500, seed: int = 8) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated snippets with the spans of their secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    rand = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    plain = lambda: rand(string.ascii_lowercase, int(rng.integers(2, 11)))
    word = lambda: pick([plain, plain, plain, plain, lambda: plain().title(), lambda: plain() + ".", lambda: plain() + ",", lambda: plain() + "é" + plain(), lambda: plain().upper(), lambda: str(int(rng.integers(10**6))), lambda: plain() + "-" + plain(), lambda: f"{plain()} = {plain()}", lambda: f"{plain()}: {int(rng.integers(10**4))}"])()
    mixed, upper, hexed = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
    out = []
    for _ in range(count):
        lead, tail = (" ".join(word() for _ in range(int(rng.integers(0, 25)))) for _ in range(2))
        kind = int(rng.integers(10))
        secrets: list[str] = []
        if kind < 5:
            s = pick([lambda: rand(mixed, int(rng.integers(16, 44))), lambda: rand(hexed, pick([32, 40, 64])), lambda: "AKIA" + rand(upper, 16), lambda: pick(["ghp_", "sk-", "xoxb-", "AIza", "glpat-"]) + rand(mixed, 30), lambda: "eyJ" + rand(mixed, 30) + "." + rand(mixed, 40), lambda: rand(mixed + "+/", 40)])()
            form = pick(['{k} = "{s}"', "{k}: {s}", "export {k}={s}", "Authorization: Bearer {s}", "{k} is {s}", "'{k}': '{s}'", "{k} {s}", "{s}", "{p}://{p}:{s}@{p}.{p}/{p}", '"{p}": "{s}"', "{p}: {s}\n{p}"])
            if form == "{s}" and len(s) < 20 or "{k}" not in form and len(s) < 16:
                form = "{k}={s}"
            middle, secrets = form.format(p=plain(), k=pick(["password", "client_secret", "API_KEY", "auth_token", "private_key", "access key", "pwd", "credential"]), s=s), [s]
        elif kind == 5:
            lines = [rand(mixed + "+/", 64) for _ in range(int(rng.integers(2, 5)))]
            middle, secrets = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END PRIVATE KEY-----", lines
        else:
            n = int(rng.integers(1, 10000))
            middle = pick([f"{plain()}{n}@{plain()}{n % 9}.example.com", f"https://{plain()}.com/{plain()}/{n}/{plain()}{n % 99}.html", f"https://{plain()}.{plain()}/{plain()}/{plain()}-{plain()}-{n}?{plain()}={plain()}{n % 99}&{plain()}={n}", f"order-{plain()}-{2000 + n % 30}-{n:06d}", f"IMG_20{n:06d}_{plain()}.jpg", f"2024-0{1 + n % 9}-1{n % 9}T10:00:00Z", f"{plain()}_{plain()}_{plain()}{n}", f"v{n % 9}.{n % 7}.{n % 5}-{plain()}.{n}", "-".join([rand(hexed, 8), rand(hexed, 4), rand(hexed, 4), rand(hexed, 4), rand(hexed, 12)]), f"commit {rand(hexed, 40)}", f"{plain()}{plain()}{n}", f"{plain().upper()}-{plain()}-{n}-{plain()}", f"{rand(string.digits, 16)}", ".".join(str(int(x)) for x in rng.integers(0, 256, 4)), f"{plain()}.{plain()}{n}@{plain()}.example.org", f"the {pick(['key', 'token', 'password', 'secret', 'access'])} {plain()} is {plain()}", f"+{n}-{rand(string.digits, 3)}-{rand(string.digits, 7)}", f"${n}.{n % 100}", plain() * 5])
        text = f"{lead} {middle} {tail}"
        at, spans = 0, []
        for s in secrets:
            at = text.index(s, at)
            spans.append((at, at + len(s)))
            at += len(s)
        out.append((text, spans))
    return out


@functools.cache
def model() -> Model:
    """The chain, trained once per process that asks for it (the driver)."""
    texts = examples()
    x, first, y = [], [np.zeros(1, np.int64)], []
    for lo, hi, data, offsets in text_pieces(pa.array([t for t, _ in texts])):
        starts, ends, at = tokens(data, offsets)
        x.append(features(data, offsets, starts, ends, at))
        first.append(at[1:] + first[-1][-1])
        for d in range(lo, hi):
            own = slice(at[d - lo], at[d - lo + 1])
            last, spans = OUT, [tuple(len(texts[d][0][:k].encode()) + offsets[d - lo] for k in s) for s in texts[d][1]]
            for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True):
                inside = any(a < e and s < b for s, e in spans)
                last = (INSIDE if last != OUT else BEGIN) if inside else OUT
                y.append(last)
    return train(np.concatenate(x).astype(float), np.concatenate(first), np.array(y), 3, rounds=160)


def base_spans(text: str, whole: bool = False) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted; whole: of the whole matches, with what announces the secret."""
    found = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        for m in (_HEX if k == 2 else pattern).finditer(text):  # runs of hex digits are maximal either way
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(0 if whole else group), k, m.end(group)))
    return sorted(found)


def scan(docs: DataFrame, *keep: str, whole: bool = False) -> DataFrame:
    """docs' `keep` columns with spans: array of (kind, start, end), by start and kind; whole as in `base_spans`."""
    chain = model()
    fields = docs.select(*keep).schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(fields))
            maybe = pc.match_substring_regex(texts, _MAYBE).fill_null(False).to_numpy(zero_copy_only=False)
            spans: list[list[dict]] = [[] for _ in range(len(texts))]
            for lo, hi, data, offsets in text_pieces(texts, PIECE):
                of, starts, ends = chain_runs(chain, data, offsets)
                for d in np.union1d(np.flatnonzero(maybe[lo:hi]), of).tolist():
                    own = data[offsets[d] : offsets[d + 1]]
                    found = base_spans(own.tobytes().decode("utf-8", "replace"), whole) if maybe[lo + d] else []
                    mine = slice(np.searchsorted(of, d), np.searchsorted(of, d, "right"))
                    if mine.start < mine.stop:
                        chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                        found = sorted(found + _beside(own, chars, starts[mine] - offsets[d], ends[mine] - offsets[d], found))
                    spans[lo + d] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]
            kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(spans, pa.list_(kinds))], names=[*fields, "spans"])

    schema = docs.select(*keep, F.expr("cast(null as array<struct<kind:string,start:bigint,end:bigint>>)").alias("spans")).schema
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(lambda x: trimmed(run(x)), schema)


def _beside(own: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The chain's spans in code points, without full stops at their ends, and without those that meet known spans."""
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        while b > a + 1 and own[b - 1] == 46:
            b -= 1
        a, b = int(chars[a]), int(chars[b])
        if not any(a < e and s < b for s, _, e in known):
            out.append((a, 3, b))
    return out


def chain_spans(chain: Model, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the chain adds to the known spans of one text."""
    own = np.frombuffer(text.encode(), np.uint8)
    _, starts, ends = chain_runs(chain, own, np.array([0, len(own)]))
    return _beside(own, np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)]), starts, ends, known)


def joined(where: str = "true") -> F.Column:
    """The spans that meet a condition on s, as kind:start:end joined by commas."""
    return F.expr(f"array_join(transform(filter(spans, s -> {where}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def mask(docs: DataFrame, sign: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by the sign and n_chars following it; other columns stay."""
    names = docs.columns
    found = scan(docs, *names)
    # merged from the back: a span that begins inside the one before it only extends it
    merged = F.expr("aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>), (m, s) -> CASE WHEN size(m) > 0 AND s.start < element_at(m, -1).b THEN concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).a AS a, greatest(element_at(m, -1).b, s.end) AS b))) ELSE concat(m, array(struct(s.start AS a, s.end AS b))) END)")
    text = F.expr("aggregate(merged, struct('' AS t, cast(0 as bigint) AS at), (m, s) -> struct(concat(m.t, substring(text, cast(m.at + 1 as int), cast(s.a - m.at as int)), '%s') AS t, s.b AS at), m -> concat(m.t, substring(text, cast(m.at + 1 as int))))" % sign)
    out = found.withColumn("merged", merged).withColumn("text", F.when(F.size("merged") > 0, text).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size("merged") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), "doc_id", whole=True)
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(F.encode(joined("s.kind <> 'chain'"), "UTF-8"), 256).alias("base_sha256"), joined().alias("spans"))
