"""Suffix arrays by induced sorting, and permuted common prefixes, array at a time.

Suffixes are classified as smaller (S) or larger (L) than the next; the leftmost of each run of S
suffixes (LMS) are sorted first, all others are induced from them in one pass up and one pass down
the buckets of first symbols. Within a bucket the pass advances in arrays: all suffixes that a
stretch of sorted suffixes induces are found at once and dealt, in order, to the buckets of their
first symbols; only suffixes of the same symbol have to be taken up again. A reduced string has many
symbols and buckets of a suffix or two: there the same passes fill the buckets one suffix at a time, by
their offsets. Every level is sorted by induction, down to one whose symbols all differ.
"""

from __future__ import annotations

import numpy as np

#: Suffixes a bucket of first symbols must hold on average to be dealt as arrays; smaller buckets are filled one by one.
WIDE = 256


def is_smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the unique smallest."""
    n = len(s)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    known = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(known[::-1])[::-1]
    return step[at] > 0


class _Deal:
    """Suffixes waiting in the bucket of each first symbol."""

    def __init__(self, symbols: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def put(self, at: np.ndarray, first: np.ndarray) -> None:
        if not len(at):
            return
        order = np.argsort(first, kind="stable")
        at, first = at[order], first[order]
        edge = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part, c in zip(np.split(at, edge), first[np.concatenate([[0], edge])].tolist()):
            self.parts[c].append(part)

    def take(self, c: int) -> np.ndarray | None:
        got, self.parts[c] = self.parts[c], []
        return None if not got else got[0] if len(got) == 1 else np.concatenate(got)


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The order of all suffixes (of LMS substrings, if `lms` is not sorted yet) from that of the LMS ones."""
    if len(s) < WIDE * symbols:
        return _induce_by_offsets(s, smaller, lms, symbols)
    start = _Deal(symbols)
    start.put(lms, s[lms])
    up, down = _Deal(symbols), _Deal(symbols)
    larger_of: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    last = np.array([len(s) - 1], lms.dtype)

    def before(part: np.ndarray, want_smaller: bool) -> np.ndarray:
        p = part[part > 0] - 1
        return p[smaller[p] == want_smaller]

    for c in range(symbols):
        while (part := up.take(c)) is not None:
            larger_of[c].append(part)
            p = before(part, False)
            up.put(p, s[p])
        if (part := start.take(c)) is not None:
            p = before(part, False)
            up.put(p, s[p])
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        own = []
        if c == s[-1]:
            own.append(last)
            p = before(last, True)
            down.put(p, s[p])
        while (part := down.take(c)) is not None:
            own.append(part)
            p = before(part, True)
            down.put(p, s[p])
        out += own
        if larger_of[c]:
            part = larger_of[c][0] if len(larger_of[c]) == 1 else np.concatenate(larger_of[c])
            part = part[::-1]
            out.append(part)
            p = before(part, True)
            down.put(p, s[p])
    return np.concatenate(out)[::-1]


def _induce_by_offsets(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """`induce` for small buckets: each has a head and a tail in one list, moved as suffixes come in."""
    per = np.bincount(s, minlength=symbols)
    ends = np.cumsum(per)
    order = [-1] * len(s)
    # the symbol of each suffix's predecessor if that is larger, or smaller; -1 if not, and for empty places
    before = np.concatenate([[-1], s[:-1].astype(np.int64), [-1]])
    small = np.concatenate([[False], smaller[:-1], [False]])
    tail = ends.tolist()
    for p, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist()):
        tail[c] -= 1
        order[tail[c]] = p
    symbol = np.where(small, -1, before).tolist()
    head = (ends - per).tolist()
    for p in order:  # reads what it has put there
        c = symbol[p]
        if c >= 0:
            at = head[c]
            order[at] = p - 1
            head[c] = at + 1
    symbol = np.where(small, before, -1).tolist()
    tail = ends.tolist()
    for p in reversed(order):
        c = symbol[p]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            order[at] = p - 1
    return np.array(order, np.int32)


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of `s`, sorted. s[-1] is 0 and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    smaller = is_smaller(s)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        rough = induce(s, smaller, lms, symbols)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        rough = rough[is_lms[rough]]
        name = np.empty(n, np.int32)
        name[rough] = np.cumsum(_differ(s, lms, rough))
        reduced = name[lms]  # the last is the end, named 0
        if int(reduced.max()) + 1 == len(lms):
            order = np.empty(len(lms), np.int32)
            order[reduced] = np.arange(len(lms), dtype=np.int32)
        else:
            order = suffix_array(reduced, int(reduced.max()) + 1)
        lms = lms[order]
    return induce(s, smaller, lms, symbols).astype(np.int32)


def _differ(s: np.ndarray, lms: np.ndarray, rough: np.ndarray) -> np.ndarray:
    """1 where a sorted LMS substring differs from the one before, compared symbol by symbol."""
    ends = np.append(lms[1:], lms[-1])
    size = np.zeros(len(s), np.int32)
    size[lms] = ends - lms + 1
    a, b = rough[:-1], rough[1:]
    za, zb = size[a], size[b]
    diff = za != zb
    live = np.flatnonzero(~diff)
    k = 0
    while len(live):
        bad = s[a[live] + k] != s[b[live] + k]
        diff[live[bad]] = True
        k += 1
        live = live[~bad]
        live = live[za[live] > k]
    return np.concatenate([[0], diff.astype(np.int32)])


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, enough: int | None = None) -> np.ndarray:
    """PLCP: for each position, the common prefix with the suffix before it in the array.

    It falls by at most one from a position to the next, so it is compared only where the symbols before
    the two suffixes differ (irreducible) and follows from the left elsewhere. With `enough`, values from
    there on may be smaller than they are, but not under `enough`.
    """
    n = len(s)
    s = s.astype(np.uint8) if s.dtype != np.uint8 else s
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    i = np.arange(n, dtype=np.int32)
    cut = np.ones(n, bool)
    inner = np.flatnonzero(phi[1:] > 0) + 1
    cut[inner] = s[inner - 1] != s[phi[inner] - 1]
    if enough:  # so that a value cut short never runs on to the right
        cut |= i % 8 == 0
    heads = np.flatnonzero(cut & (phi >= 0))
    most = n if enough is None else enough + 8
    length = np.zeros(n, np.int64)
    wide = np.concatenate([s, np.zeros(8, np.uint8)])
    w8 = np.ndarray((n + 1,), "<u8", buffer=wide, strides=(1,))
    a, b, live, done = heads.astype(np.int64), phi[heads].astype(np.int64), heads, 0
    while len(live) and done < most:
        x = w8[a] ^ w8[b]
        same = x == 0
        short = ~same
        y = x[short]
        low = y & (~y + np.uint64(1))
        length[live[short]] += np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3
        length[live[same]] += 8
        live, a, b, done = live[same], a[same] + 8, b[same] + 8, done + 8
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
    # value + position is constant along a reducible run
    anchor = np.maximum.accumulate(np.where(cut, i, 0))
    out = length[anchor] - (i - anchor)
    out[phi < 0] = 0
    return np.maximum(out, 0)
