"""Suffix arrays by induced sorting over numpy arrays, and the common prefixes that go with them.

Where a text has few letters the induced scans run bucket by bucket: all entries of a bucket's filled part hand on their
predecessors at once, in order, so a scan is linear and takes a few array steps for each letter. The reduced strings of
the recursion have many letters (names) for their length; there the same scans go entry by entry.
"""

from __future__ import annotations

import numpy as np

#: A text with fewer places than this for each of its letters is scanned entry by entry.
PLACES = 64


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of t (unsigned integers, all over zero) in order of their first `depth` letters at least; suffixes that agree further keep some order."""
    return _sorted(np.r_[t.astype(np.int32), np.int32(0)], depth)[1:]


def _stable(sort_by: np.ndarray) -> np.ndarray:
    return np.argsort(sort_by.astype(np.uint16) if sort_by.size and sort_by.max() < 1 << 16 else sort_by, kind="stable")


def _ranks(by: np.ndarray) -> np.ndarray:
    """The place of each element among its equals; by is in order."""
    starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
    return np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))


def _sorted(t: np.ndarray, depth: int) -> np.ndarray:
    """t ends with its only zero."""
    n = len(t)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    change = np.flatnonzero(t[1:] != t[:-1])
    smaller = np.repeat(t[change] < t[change + 1], np.diff(np.r_[-1, change]))
    small = np.r_[smaller, True]  # a suffix less than the one after it
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1  # leftmost of those
    sizes = np.bincount(t)
    order = _induced(t, small, lms, sizes)
    at_lms = np.zeros(n, bool)
    at_lms[lms] = True
    first = order[at_lms[order]]  # in the order of the substrings up to the next of their kind
    names, count = _named(t, lms, first)
    if count < len(lms) and depth > 1:
        first = lms[_sorted(np.r_[names + 1, np.int32(0)], -(-depth // 2))[1:]]
    return _induced(t, small, first, sizes)


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones: these go to their buckets' ends in the given order, then a scan
    upward places the larger suffixes and a scan downward the smaller ones."""
    n, ends = len(t), np.cumsum(sizes)
    if n < PLACES * len(sizes):
        return _induced_singly(t, small, lms, ends, sizes)
    heads, sa = ends - sizes, np.full(n, -1, np.int32)
    o = _stable(t[lms])
    by = t[lms[o]]
    tail = np.bincount(by, minlength=len(sizes))
    sa[ends[by] - tail[by] + _ranks(by)] = lms[o]
    fill, letters = heads.copy(), np.flatnonzero(sizes)

    def put(batch: np.ndarray, kind: bool, step: int) -> None:
        before = batch - 1
        before = before[(before >= 0) & (small[before] == kind)]
        if len(before):
            by = t[before]
            o = _stable(by)
            by, before = by[o], before[o]
            ranks = _ranks(by)
            sa[fill[by] + (ranks if step > 0 else -1 - ranks)] = before
            last = np.flatnonzero(np.r_[by[1:] != by[:-1], True])
            fill[by[last]] += step * (ranks[last] + 1)

    for c in letters:
        at = heads[c]
        while at < fill[c]:
            batch, at = sa[at : fill[c]], fill[c]
            put(batch, False, 1)
        if tail[c]:
            put(sa[ends[c] - tail[c] : ends[c]], False, 1)
    larger, fill = fill, ends.copy()
    for c in letters[::-1]:
        at = ends[c]
        while at > fill[c]:
            batch, at = sa[fill[c] : at][::-1], fill[c]
            put(batch, True, -1)
        if larger[c] > heads[c]:
            put(sa[heads[c] : larger[c]][::-1], True, -1)
    sa[0] = n - 1
    return sa


def _induced_singly(t: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What _induced gives, an entry at a time."""
    letters, kinds, n = t.tolist(), small.tolist(), len(t)
    heads, tails, sa = (ends - sizes).tolist(), ends.tolist(), [-1] * n
    for at in lms[::-1].tolist():
        c = letters[at]
        tails[c] -= 1
        sa[tails[c]] = at
    for at in sa:  # grows ahead of the scan
        if at > 0 and not kinds[at - 1]:
            c = letters[at - 1]
            sa[heads[c]] = at - 1
            heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, -1, -1):
        at = sa[i]
        if at > 0 and kinds[at - 1]:
            c = letters[at - 1]
            tails[c] -= 1
            sa[tails[c]] = at - 1
    sa[0] = n - 1
    return np.array(sa, np.int32)


def _named(t: np.ndarray, lms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each leftmost-smaller substring, in text order: equal for equal substrings, rising with their order."""
    lengths = np.zeros(len(t), np.int32)
    lengths[lms] = np.diff(np.r_[lms, len(t) - 1])
    a, b = first[:-1], first[1:]
    same = lengths[a] == lengths[b]
    live, at = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live] + at, b[live] + at
        equal = t[np.minimum(x, len(t) - 1)] == t[np.minimum(y, len(t) - 1)]
        same[live[~equal]] = False
        live = live[equal & (lengths[a[live]] > at)]
        at += 1
    number = np.zeros(len(t), np.int32)
    number[first] = np.cumsum(np.r_[0, ~same])
    return number[lms], int((~same).sum()) + 1


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the suffix just before it in the array (-1: none), and how many bytes they share, up to `most`.

    Where the position before shares a byte with the suffix before that one, the number is one less; only the other
    positions, and `starts`, are compared, eight bytes at a time. What a compared position counts past `most` is missing
    from those that follow it, up to the next.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.r_[t, np.zeros(most + 16, np.uint8)]
    words = np.zeros(n + most + 8, np.uint64)
    for j in range(8):
        words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(8 * j)
    led = np.r_[True, (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (t[:-1] != t[before[:-1]])]
    if starts is not None:
        led[starts] = True
    heads = np.flatnonzero(led)
    shared = np.zeros(len(heads), np.int64)
    live, at = np.flatnonzero(before[heads] >= 0), 0
    while len(live) and at < most:
        x = words[heads[live] + at] ^ words[before[heads[live]] + at]
        ended = x != 0
        shared[live[ended]] = at + np.bitwise_count((x[ended] & -x[ended]) - np.uint64(1)).astype(np.int64) // 8
        live = live[~ended]
        at += 8
    shared[live] = most
    chain = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, n]))
    return before, np.maximum(shared[chain] - (np.arange(n) - heads[chain]), 0)
