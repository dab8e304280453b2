"""The text kernels, suffix arrays, sketches and chains against plain versions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import crf, fingerprint, packing, secrets
from tessera.llm.common import Words, blocks, byte_values, sliding_min, text_pieces
from tessera.llm.embedding_dedup import block_links, spherical_kmeans
from tessera.llm.jaccard_join import join_sets
from tessera.llm.suffix_array import permuted_prefixes, suffix_array
from tessera.llm.suffix_dedup import partnered

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é\n\t\x0b\xa0ß"), max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    for lo, hi, data, offsets in text_pieces(pa.array(texts, pa.string()), 16):
        w = Words(data, offsets)
        for d, t in enumerate(texts[lo:hi]):
            got = [data[a:b].tobytes().decode() for a, b in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]], strict=True)]
            assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=5))
def test_equal_windows_share_their_anchor(texts):
    for _, _, data, offsets in text_pieces(pa.array(texts)):
        b = blocks(byte_values(data), offsets, 6, 3)
        seen = {}
        total = 0
        for doc, start, n, fp in zip(b["doc"], b["start"], b["n"], b["fp"], strict=True):
            total += n
            for s in range(start, start + n):
                window = texts[doc][s : s + 6]
                assert seen.setdefault(window, fp) == fp
        assert total == sum(max(0, len(t) - 5) for t in texts)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 100, 50)
    for w in (1, 2, 3, 7, 8, 50):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(51 - w)]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=60))
def test_suffix_array(s):
    raw = np.frombuffer(s.encode(), np.uint8)
    order = suffix_array(np.append(raw.astype(np.int16) + 1, np.int16(0)), 257)
    want = sorted(range(len(s) + 1), key=lambda i: s[i:])
    assert order.tolist() == want
    p = permuted_prefixes(raw, order)
    for a, b in zip(want[1:], want[2:], strict=False):
        n = 0
        while a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert p[b] == n


def partners(texts, length, gram, single=None):
    """The blocks of the texts, and those that `partnered` keeps."""
    raw = "".join(texts).encode()
    b = blocks(byte_values(np.frombuffer(raw, np.uint8)), np.cumsum([0, *(len(t.encode()) for t in texts)]), length, gram)
    bodies = [raw[a : a + n + length - 1] for a, n in zip(b["at"], b["n"], strict=True)]
    single = np.ones(len(bodies), bool) if single is None else np.array([single(k) for k in range(len(bodies))], bool)
    kept = partnered(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]), b["n"], b["fp"], single, length, gram)
    return bodies, single, set(kept.tolist())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=60), min_size=1, max_size=6), st.sampled_from([(6, 3), (17, 4), (20, 1), (40, 5)]), st.integers(1, 3))
def test_bodies_with_a_shared_window_are_kept(texts, sizes, every):
    bodies, single, kept = partners(texts, *sizes, lambda k: k % every == 0)
    windows = [{b[i : i + sizes[0]] for i in range(len(b) - sizes[0] + 1)} for b in bodies]
    for i, a in enumerate(windows):
        for j, b in enumerate(windows):
            if i != j and a & b and (single[i] or single[j]):
                assert {i, j} <= kept


def test_bodies_that_share_too_little_are_not_sorted():
    """A passage of 300 bytes in each text is no string of 400 bytes: no block of it has a partner; one of 500 bytes has."""
    rng = np.random.default_rng(2)
    some = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    for size in (300, 500):
        passage = some(size)
        bodies, _, kept = partners([some(700) + passage + some(700) for _ in range(20)], 400, 32)
        assert len(bodies) > 100 and len(kept) == 0 if size == 300 else 20 <= len(kept) < len(bodies) / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=14))
def test_join_sets_finds_the_components(sets):
    percent = 60

    def roots(edges):
        label = list(range(len(sets)))
        for a, b in edges:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    got = join_sets([np.array(sorted(x), np.uint64) for x in sets], percent)
    assert set(map(tuple, map(sorted, got))) <= set(map(tuple, map(sorted, want)))
    assert roots(got) == roots(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300))), min_size=1, max_size=6))
def test_peeling_recovers_the_differences(pairs):
    flat = lambda k: (fingerprint._mix(np.array([x for p in pairs for x in sorted(p[k])], np.uint64)), np.cumsum([0] + [len(p[k]) for p in pairs]))
    assert fingerprint.differences(*flat(0), *flat(1)).tolist() == [len(a ^ b) for a, b in pairs]


def test_chain_matches_brute_force():
    rng = np.random.default_rng(3)
    m = crf.Model(rng.normal(size=(4, 3)), rng.normal(size=(3, 3)))
    x, first = rng.normal(size=(7, 4)), np.array([0, 4, 4, 7])
    p, _, _ = crf.marginals(m, x, first)
    best = crf.viterbi(m, x, first)
    for a, b in ((0, 4), (4, 7)):
        paths = np.array(np.meshgrid(*[range(3)] * (b - a), indexing="ij")).reshape(b - a, -1).T
        s = np.array([sum(x[a + i] @ m.weights[:, y] for i, y in enumerate(path)) + sum(m.moves[u, v] for u, v in zip(path[:-1], path[1:], strict=True)) for path in paths])
        w = np.exp(s - s.max())
        w /= w.sum()
        assert np.allclose(p[a:b], [[w[paths[:, i] == k].sum() for k in range(3)] for i in range(b - a)])
        assert best[a:b].tolist() == paths[s.argmax()].tolist()


def test_best_fit():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 101, 500)
    bins, offsets, loads = packing.best_fit(n, 100)
    assert loads.max() <= 100 and loads.sum() == n.sum() and len(loads) <= 1.05 * n.sum() / 100 + 1
    for b in range(len(loads)):
        at = 0
        for i in sorted(np.flatnonzero(bins == b), key=lambda i: offsets[i]):
            assert offsets[i] == at
            at += n[i]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aAbZ'sdrevmlz.,!?#01_-<|>ndoftxSTÄäßéÈñ×÷þĂİıŉœΣσς é́中\n\t")), max_size=16), min_size=1, max_size=4))
def test_ids_are_the_tokenizers(texts):
    pytest.importorskip("public_tokenizers")
    with open(packing.default_tokenizer()) as f:
        w = packing._word_ids(f.read())
    for _, _, data, offsets in text_pieces(pa.array(texts)):
        ids, bounds = w.piece(data, offsets)
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*w.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_secrets_of_snippets():
    m = secrets.model()
    hits = total = false = clean = 0
    for text, spans in secrets.examples(600, seed=99):  # others than those it was trained on
        base = secrets.base_spans(text)
        found = base + secrets.chain_spans(m, text, base)
        total += len(spans)
        hits += sum(any(a < e and s < b for s, _, e in found) for a, b in spans)
        if not spans:
            clean += 1
            false += any(k == 3 for _, k, _ in found)
    assert hits / total > 0.9 and false / clean < 0.05


def test_block_links():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[30:] = x[:30] + 0.05 * rng.normal(size=(30, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = spherical_kmeans(x, 3)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
    one = np.zeros((60, 1), np.int64)
    ids, least, links = block_links(np.arange(60), np.ones(60, np.int64), x, one, 0, np.zeros(60, np.int64), True, 0.9)
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert dict(zip(ids, links, strict=True)) == {i: n for i, n in enumerate(want) if n}
