"""Nearest names against all pairs, and code in which they are set right."""

import difflib
import random

import pytest

from tessera.operators import fuzzy


def nearest(wanted, known, ratio=0.85, short=0.7, long=1.4):
    for name in sorted(wanted - known):
        same = sorted(k for k in known if k.lower() == name.lower())
        found = [(-r, k) for k in known if short <= len(k) / len(name) <= long and (r := difflib.SequenceMatcher(None, name.lower(), k.lower()).ratio()) >= ratio]
        if same or found:
            yield (name, same[0], 1.0) if same else (name, min(found)[1], pytest.approx(-min(found)[0]))


def damaged(rng, word):
    for _ in range(rng.randint(1, 3)):
        at = rng.randrange(len(word) + 1)
        word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abz_") + word[at:], word[:at] + rng.choice("abz") + word[at + 1 :]])
    return word


@pytest.mark.parametrize("seed", [1, 2])
def test_closest(spark, seed):
    """No partner is missed: letters differ at the beginning, at the end and between; many names share a pair."""
    rng = random.Random(seed)
    known = {"get_" * rng.randrange(2) + "".join(rng.choice("abcde_") for _ in range(rng.randrange(1, 22))) for _ in range(150)} | {"getUser", "GETUSER", "x", "ab", "a" * 40}
    wanted = {damaged(rng, k) for k in known for _ in range(2)} | {"xgetUser", "etUser", "getuser", "X", "ba", "a" * 38 + "b", "nothing_like_it"}
    wanted = {w for w in wanted if w}
    of = lambda names: spark.createDataFrame([(n,) for n in sorted(names)] + [(None,)], "name string")
    got = {(r.name, r.match): r.ratio for r in fuzzy.closest(of(wanted), of(known)).collect()}
    want = {(n, m): r for n, m, r in nearest(wanted, known)}
    assert len(want) > 60 and got == want
    assert ("xgetUser", "GETUSER") in got or ("xgetUser", "getUser") in got


def test_shared_pairs():
    """The bound holds for all pairs of short words of two letters."""
    import itertools
    from collections import Counter

    words = ["".join(w) for n in range(2, 7) for w in itertools.product("ab", repeat=n)]
    cut = {w: Counter(w[i : i + 2] for i in range(len(w) - 1)) for w in words}
    for a in words:
        for b in words:
            if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.85:
                assert sum((cut[a] & cut[b]).values()) >= fuzzy.shared_pairs(len(a))


def test_corrected(spark):
    code = "# lod_data(x)\nlod_data(1); lod_data(2)\nprint(y); Len(z)\nmy_load_dat(3)\nfrom_file = CacheStor.open_fil(4)\nload_data()\nCachestore2 (5)\n"
    blocks = spark.createDataFrame([(1, code), (2, None), (3, "")], "k int, code string")
    functions = spark.createDataFrame([("load_data",), ("open_file",), ("println",)], "name string")
    classes = spark.createDataFrame([("CacheStore",)], "name string")
    got = {r.k: r for r in fuzzy.corrected(blocks, "k", "code", functions, classes).collect()}
    assert got[1].code == code.replace("\nlod_data(1)", "\nload_data(1)").replace("CacheStor.", "CacheStore.").replace("open_fil(", "open_file(").replace("Cachestore2", "CacheStore")
    assert [(c.name, c.kind) for c in got[1].corrections] == [("lod_data", "function"), ("open_fil", "function"), ("CacheStor", "class"), ("Cachestore2", "class")]
    assert got[2].code is None and got[3].code == "" and not got[3].corrections
