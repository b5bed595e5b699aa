"""Suffix arrays by induced sorting, with whole-bucket array steps in place of the one-suffix-at-a-time scans.

Suffixes are classified as smaller (S) or larger (L) than the next; the leftmost S of each run start substrings that are sorted by a
first induction and named, equal substrings alike. If names repeat, the string of names is sorted in the same way, recursively. A second induction from
the sorted leftmost-S suffixes gives the array. An induction scans the buckets in order; all entries that a bucket holds at one
time are handled together, so a step is linear in them.

A string of names has as many symbols as there are names. Where these are many, each name is written as two digits, which keeps the
order of its suffixes and leaves few buckets to scan; the string handed down is then still shorter than the one above.
"""

from __future__ import annotations

import math

import numpy as np

from sondeflow.llm.common import U64

#: Names up to which each is one symbol of the string handed down.
WIDEST = 256
#: Symbols of a string that is short enough to compare its suffixes directly, and entries that are put one by one.
SHORT, FEW = 4096, 200


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte array in lexicographic order."""
    if len(text) < 2:
        return np.arange(len(text))
    return _sorted(np.append(text.astype(np.int32) + 1, np.int32(0)), 257)[1:]


def _sorted(t: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of a string that ends with its only 0, the smallest symbol."""
    if len(t) <= SHORT and symbols <= 1 << 16:
        whole = t.astype(">u2").tobytes()
        return np.array(sorted(range(len(t)), key=lambda i: whole[2 * i :]), np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    start = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=symbols))))
    first = _induced(t, small, start, lms)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    name_at, names = _names(t, lms, ordered)
    if names < len(lms):
        ordered = lms[_by_names(name_at, names, len(t))]
    return _induced(t, small, start, ordered)


def _by_names(name: np.ndarray, names: int, above: int) -> np.ndarray:
    """Order of the suffixes of a string of names, taken from a string of `above` symbols."""
    if names <= WIDEST or 2 * len(name) > 0.9 * above:
        return _sorted(np.append(name + 1, 0).astype(np.int32), names + 1)[1:]
    base = math.isqrt(names - 1) + 1
    digits = np.zeros(2 * len(name) + 1, np.int32)
    digits[0:-1:2], digits[1::2] = name // base + 1, name % base + 1
    order = _sorted(digits, base + 1)[1:]
    return order[order % 2 == 0] // 2


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next: by the next symbol that differs."""
    n = len(t)
    differs = np.append(t[1:] != t[:-1], True)
    up = np.append(t[:-1] < t[1:], True)
    at = np.where(differs, np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _induced(t: np.ndarray, small: np.ndarray, start: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The array that follows from the leftmost-S suffixes in the given order (of each bucket)."""
    sa = np.full(len(t), -1, np.int64)
    head, tail = start[:-1].copy(), start[1:].copy()
    seeds = lms[np.argsort(t[lms], kind="stable")]
    cut = np.searchsorted(t[seeds], np.arange(len(start)))
    kind = np.int16 if len(start) < 1 << 15 else np.int32
    before = np.full((2, len(t)), -1, kind)  # the symbol before each suffix, if it is smaller (0) or larger (1) than what follows
    before[0, 1:], before[1, 1:] = np.where(small[:-1], t[:-1], -1), np.where(small[:-1], -1, t[:-1])
    along, dense = np.arange(len(t)), len(start) <= 1024
    out, symbol, ends_of = memoryview(sa), (memoryview(before[0]), memoryview(before[1])), (memoryview(tail), memoryview(head))

    def put(where: np.ndarray, forward: bool) -> None:
        """The suffixes before these, if of the type sought, to the free end of their buckets, in this order."""
        if len(where) <= FEW:
            symbols, end = symbol[forward], ends_of[forward]
            for x in where.tolist():
                c = symbols[x]
                if c >= 0:
                    if forward:
                        out[end[c]] = x - 1
                        end[c] += 1
                    else:
                        end[c] -= 1
                        out[end[c]] = x - 1
            return
        c = before[int(forward)][where]
        keep = np.flatnonzero(c >= 0)
        if not len(keep):
            return
        c, x = c[keep], where[keep]
        by = np.argsort(c, kind="stable")
        c, x = c[by], x[by]
        if dense:
            own, count = slice(None), np.bincount(c, minlength=len(start) - 1)
            first = (np.cumsum(count) - count)[c]
        else:
            edge = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            own, count = c[edge], np.diff(np.append(edge, len(c)))
            first = np.repeat(edge, count)
        if forward:
            sa[head[c] + along[: len(c)] - first] = x - 1
            head[own] += count
        else:
            sa[tail[c] - 1 - along[: len(c)] + first] = x - 1
            tail[own] -= count

    present = np.flatnonzero(np.diff(start))
    for c in present:
        at = start[c]
        while at < head[c]:
            at, now = head[c], sa[at : head[c]]
            put(now, True)
        put(seeds[cut[c] : cut[c + 1]], True)
    ends = head.copy()
    sa[0] = len(t) - 1  # the closing symbol
    for c in present[::-1]:
        at = start[c + 1]
        if c:
            while at > tail[c]:
                at, now = tail[c], sa[tail[c] : at][::-1]
                put(now, False)
        put(sa[start[c] : ends[c]][::-1] if c else sa[:1], False)
    return sa


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each leftmost-S substring (up to and with the next one's first symbol), equal for equal ones, in order; in the text's order."""
    size_at = np.zeros(len(t), np.int64)
    size_at[lms] = np.append(lms[1:] + 1, len(t)) - lms
    a, b = ordered[1:], ordered[:-1]
    fresh = np.ones(len(ordered), bool)
    alike = np.flatnonzero(size_at[a] == size_at[b])
    if len(alike):
        size = size_at[a[alike]]
        first = np.cumsum(size) - size
        along = np.arange(int(size.sum())) - np.repeat(first, size)
        differ = t[np.repeat(a[alike], size) + along] != t[np.repeat(b[alike], size) + along]
        fresh[1 + alike] = np.add.reduceat(differ, first, dtype=np.int64) > 0
    name = np.cumsum(fresh) - 1
    rank_of = np.zeros(len(t), np.int64)
    rank_of[lms] = np.arange(len(lms))
    out = np.empty(len(lms), np.int64)
    out[rank_of[ordered]] = name
    return out, int(name[-1]) + 1


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in `order`, in the order of the text, the common prefix with the one before it in `order`, up to `most` (0 for the first).

    Every suffix must have `most` bytes left.
    """
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.sort(order)
    other = before[at]
    pad = np.concatenate((text, np.zeros(8, np.uint8)))
    word = np.zeros(len(text), U64)
    for k in range(8):
        word |= pad[k : k + len(text)].astype(U64) << U64(8 * k)
    alive = other >= 0
    length = np.zeros(len(at), np.int64)
    for k in range(0, most, 8):
        width = min(8, most - k)
        i = np.flatnonzero(alive)
        x = word[at[i] + k] ^ word[other[i] + k]
        if width < 8:
            x &= U64((1 << 8 * width) - 1)
        same = x == 0
        low = x[~same] & (~x[~same] + U64(1))
        length[i[same]] += width
        length[i[~same]] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        alive[i[~same]] = False
    out = np.zeros(len(text), np.int64)
    out[at] = length
    return out
