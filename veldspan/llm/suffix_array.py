"""Suffix arrays by induced sorting, and permuted common prefixes, in array operations.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour.  Leftmost S
suffixes (LMS), put into the buckets of their characters, induce the order of the substrings
between them: of all L suffixes in one pass over the buckets upwards, and of all S suffixes
in one pass downwards.  The substrings are named by their order; if names repeat, the string
of names is sorted by the same method.  The order of the LMS suffixes found so induces that
of all suffixes.

A pass handles the entries of a span of buckets together: buckets that put nothing into each
other.  So an alphabet of many rare names needs few steps.  Characters that repeat
their neighbour come in further waves, as many as the longest run of one character.
"""

from __future__ import annotations

import numpy as np


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one is not."""
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)
    smaller = np.zeros(len(ends), bool)
    smaller[:-1] = t[ends[:-1]] < t[ends[:-1] + 1]
    return np.repeat(smaller, np.diff(np.append(-1, ends)))


def spans(t: np.ndarray, alphabet: int) -> tuple[list[int], list[int]]:
    """Bounds of the spans of buckets of the pass upwards, and of that downwards, in the order of the pass."""
    left, right = t[:-1], t[1:]
    lowest = np.full(alphabet, alphabet, np.int64)  # least character that the bucket's L suffixes go to
    highest = np.full(alphabet, -1, np.int64)
    up = left > right
    np.minimum.at(lowest, right[up], left[up])
    up = left < right
    np.maximum.at(highest, right[up], left[up])
    upward, limit = [0], alphabet
    for c, to in enumerate(lowest.tolist()):
        if c >= limit:
            upward.append(c)
            limit = alphabet
        limit = min(limit, to)
    downward, limit = [alphabet], -1
    for c, to in zip(range(alphabet - 1, -1, -1), highest[::-1].tolist()):
        if c <= limit:
            downward.append(c + 1)
            limit = -1
        limit = max(limit, to)
    return [*upward, alphabet], [*downward, 0]


def _append(sa: np.ndarray, pointer: np.ndarray, entries: np.ndarray, symbols: np.ndarray, down: bool) -> None:
    """Puts entries into the buckets of their symbols, in order, at the moving ends."""
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    first = np.concatenate([[0], first, [len(symbols)]])
    count, first = first[1:] - first[:-1], first[:-1]
    bucket = symbols[first]
    end = pointer[bucket]
    if down:
        sa[np.repeat(end + first, count) - np.arange(len(symbols))] = entries[order]
        pointer[bucket] = end - count
    else:
        sa[np.repeat(end - first, count) + np.arange(len(symbols))] = entries[order]
        pointer[bucket] = end + count


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: tuple[list[int], list[int]], counts: np.ndarray) -> np.ndarray:
    """The suffixes in order, from LMS suffixes in order; from LMS suffixes in any order, the LMS substrings are in order."""
    n = len(t)
    tails = np.cumsum(counts)
    heads = tails - counts
    edge = np.append(heads, n).tolist()
    repeats = np.append(False, t[1:] == t[:-1])
    sa = np.full(n, -1, np.int32)
    if len(lms):
        _append(sa, tails - 1, lms[::-1], t[lms[::-1]], True)

    head = heads.copy()
    _append(sa, head, np.array([n - 1], np.int32), t[n - 1 :], False)  # the last suffix is L: before it stands the end
    for lo, hi in zip(bounds[0], bounds[0][1:]):
        wave = sa[edge[lo] : edge[hi]]
        while len(wave):  # L suffixes before which their own character stands
            wave = wave[wave > 0]
            before = wave - 1
            wave = before[repeats[wave] & ~small[before]]
            if len(wave):
                _append(sa, head, wave, t[wave], False)
        here = sa[edge[lo] : edge[hi]]
        here = here[here > 0]
        before = here - 1
        before = before[t[before] > t[here]]
        if len(before):
            _append(sa, head, before, t[before], False)

    sa[small[sa] & (sa >= 0)] = -1
    tail = tails - 1
    for hi, lo in zip(bounds[1], bounds[1][1:]):
        wave = sa[edge[lo] : edge[hi]][::-1]
        while len(wave):
            wave = wave[wave > 0]
            before = wave - 1
            wave = before[repeats[wave] & small[before]]
            if len(wave):
                _append(sa, tail, wave, t[wave], True)
        here = sa[edge[lo] : edge[hi]][::-1]
        here = here[here > 0]
        before = here - 1
        before = before[t[before] < t[here]]
        if len(before):
            _append(sa, tail, before, t[before], True)
    return sa


def name_substrings(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings from 1 on, ``order`` being their order; equal for equal substrings.

    A substring ends with the next LMS character; the last one ends with the end of the
    text, which is like no other.
    """
    size = np.append(np.diff(lms), len(t) - lms[-1])
    new = np.ones(len(lms), bool)
    a, b = order[:-1], order[1:]
    last = len(lms) - 1
    alike = np.flatnonzero((size[a] == size[b]) & (a != last) & (b != last))
    length = size[a[alike]] + 1
    first = np.cumsum(length) - length
    step = np.arange(int(length.sum())) - np.repeat(first, length)
    differs = t[np.repeat(lms[a[alike]], length) + step] != t[np.repeat(lms[b[alike]], length) + step]
    if len(alike):
        new[alike + 1] = np.add.reduceat(differs, first) > 0
    names = np.zeros(len(lms), np.int64)
    names[order] = np.cumsum(new)
    return names


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``t`` (integers from 0, not much above its length) in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    counts = np.bincount(t)
    if len(counts) <= 1 << 15:
        t = t.astype(np.int16)  # small numbers sort by radix
    small = s_types(t)
    bounds = spans(t, len(counts))
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        place = np.full(n, -1, np.int32)
        place[lms] = np.arange(len(lms))
        order = place[induce(t, small, lms, bounds, counts)]
        order = order[order >= 0]
        names = name_substrings(t, lms, order)
        if int(names.max()) < len(names):
            order = suffix_array(names)
        lms = lms[order]
    return induce(t, small, lms, bounds, counts)


def common_prefixes(t: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix array entry, its common prefix with the entry before, up to ``limit``.

    Computed in text order: a position whose left character equals that of its
    predecessor's suffix has one less than the position before it, so only the others
    are compared.
    """
    n = len(t)
    prior = np.full(n, -1, np.int64)
    prior[sa[1:]] = sa[:-1]
    both = np.flatnonzero(prior > 0)
    both = both[both > 0]
    derived = np.zeros(n, bool)
    derived[both] = t[both - 1] == t[prior[both] - 1]
    todo = np.flatnonzero(~derived & (prior >= 0))
    padded = np.concatenate([t, np.zeros(limit + 1, t.dtype)])
    plcp = np.zeros(n, np.int64)
    a, b = todo, prior[todo]
    for step in range(limit):
        same = (padded[a + step] == padded[b + step]) & (np.maximum(a, b) + step < n)
        todo, a, b = todo[same], a[same], b[same]
        if not len(todo):
            break
        plcp[todo] = step + 1
    base = np.maximum.accumulate(np.where(derived, -1, np.arange(n)))
    # a derived value is exact below the limit; at the limit its source may be longer
    value = plcp[base] - (np.arange(n) - base)
    at_limit = derived & (plcp[base] >= limit)
    if at_limit.any():
        i = np.flatnonzero(at_limit)
        known = np.maximum(value[i], 0)
        x, y = i, prior[i]
        length = known.copy()
        live = np.arange(len(i))
        while len(live):
            k = length[live]
            ok = (k < limit) & (np.maximum(x[live], y[live]) + k < n)
            live, k = live[ok], k[ok]
            same = padded[x[live] + k] == padded[y[live] + k]
            live = live[same]
            length[live] += 1
        value[i] = length
    plcp = np.where(derived, np.maximum(value, 0), plcp)
    return np.minimum(plcp[sa], limit)
