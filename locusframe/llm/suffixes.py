"""Suffix arrays by induced sorting and their permuted common prefixes, with numpy.

Texts are arrays of small non-negative integers whose last is 0 and the only 0.
"""

from __future__ import annotations

import numpy as np

#: Up to this many names are sorted by recursion; beyond, buckets are too small for waves, and ranks are doubled.
SYMBOLS = 2000


def by_doubling(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffix array by rank doubling; only suffixes whose order is open are sorted again.  depth: symbols that need to be in order."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        sorted_rank = rank[order]
        new = np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]
        if new.all() or depth is not None and k >= depth:
            return order
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, n])
        head = np.repeat(start, size)  # the rank of a suffix: where its group begins
        rank = np.empty(n, np.int64)
        rank[order] = head
        at = np.flatnonzero(np.repeat(size > 1, size))
        own = order[at]
        second = np.where(own + k < n, rank[np.minimum(own + k, n - 1)], -1)
        key = head[at] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[at] = own[by]
        key = key[by]
        first = np.r_[True, key[1:] != key[:-1]]
        rank[order[at]] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        k *= 2


def _smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it."""
    n = len(text)
    differs = np.r_[text[:-1] != text[1:], True]
    at = np.where(differs, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place whose successor differs
    return np.r_[text[:-1] < text[1:], True][at]


def _place(suffixes: np.ndarray, keys: np.ndarray, sa: np.ndarray, ends: np.ndarray, step: int) -> None:
    """Puts suffixes, in their order, at the ends of their buckets, which move by ``step``."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, suffixes = keys[order], suffixes[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[start, len(keys)])
    own = keys[start]
    nth = np.arange(len(keys)) - np.repeat(start, count)
    sa[np.repeat(ends[own], count) + step * nth] = suffixes
    ends[own] += step * count


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order.

    Buckets are taken one by one and each in waves: what a wave puts into its own bucket is
    the next wave, so the order is that of a scan symbol by symbol.
    """
    n, symbols = len(text), np.flatnonzero(size)
    sa = np.full(n, -1, np.int32)
    seed_keys = text[seeds]
    order = np.argsort(seed_keys, kind="stable")
    seeds, seed_keys = seeds[order], seed_keys[order]
    seed_first = np.searchsorted(seed_keys, np.arange(len(size) + 1))
    ends = first.copy()
    for c in symbols:
        low = first[c]
        while True:
            wave, low = sa[low : ends[c]], ends[c]
            if not len(wave):
                break
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            _place(before, text[before], sa, ends, 1)
        before = seeds[seed_first[c] : seed_first[c + 1]] - 1
        before = before[before >= 0]
        _place(before, text[before], sa, ends, 1)
    larger_end = ends.copy()
    ends = first + size - 1
    sa[ends[text[-1]]] = n - 1  # nothing follows it that could induce it
    ends[text[-1]] -= 1
    for c in symbols[::-1]:
        high = first[c] + size[c] - 1
        while True:
            wave, high = sa[ends[c] + 1 : high + 1][::-1], ends[c]
            if not len(wave):
                break
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            _place(before, text[before], sa, ends, -1)
        wave = sa[first[c] : larger_end[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        _place(before, text[before], sa, ends, -1)
    return sa


def _named(text: np.ndarray, in_order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of sorted substrings: equal ones, symbol by symbol, have the same."""
    size = length[in_order]
    alike = np.flatnonzero(size[1:] == size[:-1]) + 1
    new = np.ones(len(in_order), bool)
    new[0] = False
    if len(alike):
        n = size[alike]
        start = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(start, n)
        same = text[np.repeat(in_order[alike], n) + within] == text[np.repeat(in_order[alike - 1], n) + within]
        new[alike] = ~np.logical_and.reduceat(same, start)
    return np.cumsum(new)


def induced(text: np.ndarray) -> np.ndarray:
    """The suffix array: leftmost-smaller substrings are sorted by inducing, their names by recursion, and all suffixes are induced from these."""
    if text.max(initial=0) >= SYMBOLS:
        return by_doubling(text)
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1]
    smaller = _smaller(text)
    size = np.bincount(text)
    first = np.cumsum(size) - size
    text = text.astype(np.uint16)  # sorted by digits
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = _induce(text, smaller, leftmost, first, size)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    in_order = sa[is_left[sa]]
    length = np.zeros(n, np.int64)
    length[leftmost] = np.r_[leftmost[1:], n - 1] - leftmost + 1
    by_order = _named(text, in_order, length)
    if by_order[-1] == len(in_order) - 1:
        sorted_left = in_order
    else:
        names = np.zeros(n, np.int64)
        names[in_order] = by_order
        sorted_left = leftmost[induced(names[leftmost])]
    return _induce(text, smaller, sorted_left, first, size)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each place, the length that its suffix has in common with the one before it in order; that one's place, -1 for the first).

    Permuted: in order of the text.  Where the symbols before both agree, the length is one
    less than that of the place before; elsewhere symbols are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    open_ = before <= 0
    open_[1:] |= text[:-1] != text[before[1:] - 1]
    open_[0] = True
    length, padded = np.zeros(n, np.int64), np.r_[text, np.zeros(64, text.dtype)]
    every = np.flatnonzero(open_ & (before >= 0))
    for k in range(0, len(every), 100_000):
        own, done, width = every[k : k + 100_000], 0, 8
        a, b = own, before[own]
        while len(own):
            view = np.lib.stride_tricks.sliding_window_view(padded, width)
            differs = view[a + done] != view[b + done]
            at = differs.argmax(1)
            ended = differs[np.arange(len(at)), at]
            length[own[ended]] = done + at[ended]
            own, a, b = own[~ended], a[~ended], b[~ended]
            done, width = done + width, min(64, width * 2)
    place = np.arange(n)
    source = np.maximum.accumulate(np.where(open_, place, 0))
    return np.maximum(length[source] - (place - source), 0), before


_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.r_[np.uint64(1), np.full(n, _BASE)].cumprod(dtype=np.uint64)
    return _POWERS


def prefix_hashes(text: np.ndarray) -> np.ndarray:
    """Sums of mixed symbols times powers; substrings are compared after shifting to a common power."""
    mixed = (text.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.r_[np.uint64(0), np.cumsum(mixed * _powers(len(text))[: len(text)], dtype=np.uint64)]


_INVERSE = pow(int(_BASE), -1, 1 << 64)
_INVERSES = np.ones(1, np.uint64)


def substring_hashes(prefix: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < len(prefix):
        _INVERSES = np.r_[np.uint64(1), np.full(len(prefix), np.uint64(_INVERSE))].cumprod(dtype=np.uint64)
    return (prefix[at + length] - prefix[at]) * _INVERSES[at]
