"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

The scans of induced sorting go bucket by bucket: within a bucket, entries are
taken in whole arrays, in as many rounds as the longest run of its letter.
That keeps the linear amount of work of the method without a Python step per
suffix.  The reduced string of leftmost-smaller (LMS) substrings is sorted
recursively.  Where buckets hold few suffixes each, as in reduced strings, the
same scans go suffix by suffix over plain lists; both are linear.
"""

from __future__ import annotations

import numpy as np

#: Suffixes a bucket, on average, from which a scan takes buckets as arrays.
DENSE = 256


def classify(text: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than the next); the last letter is the sentinel."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # last places of runs
    smaller = text[change] < text[change + 1]
    out = np.ones(n, bool)
    if len(change):
        ends = change + 1
        out[: ends[-1]] = np.repeat(smaller, np.diff(np.concatenate([[0], ends])))
    return out


def _deal(places: np.ndarray, letters: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Append places to their letters' lists, in order."""
    if not len(places):
        return
    # sixteen bits are sorted by counting
    order = np.argsort(letters.astype(np.uint16) if len(lists) <= 1 << 16 else letters, kind="stable")
    places, letters = places[order], letters[order]
    cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    edges = [0, *cuts.tolist(), len(places)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lists[letters[a]].append(places[a:b])


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes that follows from the order of the LMS suffixes in seeds."""
    if len(text) < DENSE * letters:
        return _induce_by_suffix(text, small, seeds, letters)
    seeded: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _deal(seeds, text[seeds], seeded)
    larger: list[list[np.ndarray]] = [[] for _ in range(letters)]
    none = np.zeros(0, np.int64)

    def before(places: np.ndarray, kind: bool, lists: list[list[np.ndarray]]) -> None:
        places = places[places > 0] - 1
        places = places[small[places] == kind]
        _deal(places, text[places], lists)

    for c in range(letters):
        done = 0
        while done < len(larger[c]):
            batch = np.concatenate(larger[c][done:])
            done = len(larger[c])
            before(batch, False, larger)
        if seeded[c]:
            before(np.concatenate(seeded[c]), False, larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(letters)]
    smaller[0].append(np.array([len(text) - 1]))
    for c in range(letters - 1, -1, -1):
        done = 0
        while done < len(smaller[c]):
            batch = np.concatenate(smaller[c][done:])
            done = len(smaller[c])
            before(batch, True, smaller)
        if larger[c]:
            before(np.concatenate(larger[c])[::-1], True, smaller)
    parts = []
    for c in range(letters):
        parts += larger[c]
        parts += [np.concatenate(smaller[c])[::-1]] if smaller[c] else []
    return np.concatenate(parts) if parts else none


def _induce_by_suffix(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """`induce` with a step per suffix, whose cost does not depend on the number of letters."""
    n = len(text)
    count = np.bincount(text, minlength=letters)
    ends = np.cumsum(count)
    heads, tails = (ends - count).tolist(), ends.tolist()
    # per suffix, the bucket of the suffix before it if that is larger (smaller) than its next; none at the end, where -1 looks
    before = text[:-1]
    larger = [-1, *np.where(small[:-1], -1, before).tolist(), -1]
    smaller = [-1, *np.where(small[:-1], before, -1).tolist(), -1]
    # LMS suffixes at the ends of their buckets, in order
    order = np.full(n, -1, np.int64)
    at = text[seeds]
    by = np.argsort(at, kind="stable")
    sizes = np.bincount(at, minlength=letters)
    order[ends[at[by]] - np.cumsum(sizes)[at[by]] + np.arange(len(seeds))] = seeds[by]
    out = order.tolist()
    for i in out:  # reads what the loop itself has put there
        c = larger[i]
        if c >= 0:
            at = heads[c]
            out[at] = i - 1
            heads[c] = at + 1
    for i in reversed(out):
        c = smaller[i]
        if c >= 0:
            at = tails[c] = tails[c] - 1
            out[at] = i - 1
    out[0] = n - 1
    return np.array(out, np.int64)


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """The sorted suffixes of text, whose last letter is 0 and occurs only there; letters: their number."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = classify(text)
    lms = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    order = induce(text, small, lms, letters)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = order[is_lms[order]]
    # names of LMS substrings: equal ones get one name
    length = np.ones(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = ordered[:-1], ordered[1:]
    same = (length[a] == length[b]) & (text[a] == text[b])
    maybe = np.flatnonzero(same)
    if len(maybe):
        size = length[a[maybe]]
        head = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(head, size)
        differs = text[np.repeat(a[maybe], size) + step] != text[np.repeat(b[maybe], size) + step]
        same[maybe] = ~np.logical_or.reduceat(differs, head)
    names = np.empty(n, np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[lms]
    kinds = int(reduced.max()) + 1
    if kinds == len(lms):
        rank = np.empty(kinds, np.int64)
        rank[reduced] = np.arange(kinds)
    else:
        rank = suffix_array(reduced, kinds)
    return induce(text, small, lms[rank], letters)


def permuted_prefixes(raw: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Per place, the common prefix of its suffix with the suffix sorted before it.

    Only irreducible values (where the letters before the two suffixes differ)
    are found by comparison, eight bytes at a time; each other value is one
    less than that of the place before.
    """
    n = len(raw)
    order = order[order < n]
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    first = (before < 0) | (place == 0) | (before == 0)
    first[1:] |= raw[:-1] != raw[np.maximum(before[1:] - 1, 0)]
    out = np.zeros(n, np.int64)
    active = np.flatnonzero(first & (before >= 0))
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    eight = np.ndarray((n + 8,), "<u8", padded.data, strides=(1,))
    at, to = active.copy(), before[active]
    while len(active):
        differ = eight[np.minimum(at, n)] ^ eight[np.minimum(to, n)]
        room = n - np.maximum(at, to)
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.floor(np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64) // 8)
        equal = np.minimum(equal, np.maximum(room, 0))
        out[active] += equal
        on = equal == 8
        active, at, to = active[on], at[on] + 8, to[on] + 8
    value = np.where(first, out + place, 0)
    return np.maximum(np.maximum.accumulate(value) - place, 0)
