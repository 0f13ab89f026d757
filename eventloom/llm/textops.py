"""Array-at-a-time text primitives: every function works on a whole Arrow batch of UTF-8 texts.

A batch is held as one byte buffer plus document offsets, so words, lines, shingles and their
hashes are found with a handful of numpy passes instead of a Python loop over documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
P1, P2, P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
P4, P5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that begin a code point.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80
#: Text bytes handled at once; bounds the working memory of a Python worker.
SLICE_BYTES = 4 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about `limit` bytes of `column` (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words (runs of bytes other than ASCII white space) of a batch, in document order.

    `norm` holds each word followed by one space; word i of the batch is
    norm[at[i] : at[i] + size[i]]; `per_doc` counts the words of each document.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        b = LOWER[buf] if lower else buf
        solid = ~IS_SPACE[b]
        n = len(b)
        before = np.zeros(n + 1, bool)
        before[1:] = solid
        before[offs] = False  # nothing joins over a document's edge
        first = solid & ~before[:n]
        after = np.zeros(n + 1, bool)
        after[:n] = solid
        after[offs] = False
        last = solid & ~after[1:]
        self.src = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        self.size = ends - self.src
        cut = np.searchsorted(self.src, offs)
        self.per_doc = np.diff(cut)
        self.first = cut[:-1]
        full = self.size + 1
        self.at = np.cumsum(full) - full
        total = int(full.sum())
        keep = np.ones(total, bool)
        keep[self.at + self.size] = False
        self.norm = np.full(total + 64, 0x20, np.uint8)
        self.norm[:total][keep] = b[solid]
        self.doc = np.repeat(np.arange(len(offs) - 1), self.per_doc)

    def hashes(self, seed: int = 42) -> np.ndarray:
        return xxh64(self.norm, self.at, self.size, seed)

    def shingles(self, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each shingle, index of its first word, shingles per document).

        A document of fewer words has one shingle: its whole sequence; one without words has none.
        """
        wc = self.per_doc
        per = np.where(wc >= width, wc - width + 1, np.minimum(wc, 1))
        start = np.repeat(self.first, per) + ragged(per)
        last = start + np.repeat(np.minimum(wc, width), per) - 1
        at = self.at[start]
        return xxh64(self.norm, at, self.at[last] + self.size[last] - at, seed), start, per


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(counts) - counts, counts)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start+size), joined."""
    return np.repeat(starts, sizes) + ragged(sizes)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, lines per document) of the pieces between newlines; an empty text has one empty line."""
    brk = np.flatnonzero(buf == 0x0A)
    in_doc = np.diff(np.searchsorted(brk, offs))
    per = in_doc + 1
    first = np.cumsum(per) - per
    start = np.empty(int(per.sum()), np.int64)
    end = np.empty_like(start)
    is_first = np.zeros(len(start), bool)
    is_first[first] = True
    is_last = np.zeros(len(start), bool)
    is_last[first + per - 1] = True
    start[is_first], start[~is_first] = offs[:-1], brk + 1
    end[is_last], end[~is_last] = offs[1:], brk
    return start, end - start, per


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc, word):
    return _rotl(acc + word * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, U64)
    if len(buf) < 16 or int((starts + sizes).max()) + 8 > len(buf):
        buf = np.concatenate([buf, np.zeros(16, np.uint8)])
    w8 = np.ndarray((len(buf) - 7,), "<u8", buffer=np.ascontiguousarray(buf), strides=(1,))
    w4 = np.ndarray((len(buf) - 3,), "<u4", buffer=w8.base if w8.base is not None else buf, strides=(1,))
    starts = starts.astype(np.int64)
    sizes = sizes.astype(np.int64)
    s = U64(seed)
    with np.errstate(over="ignore"):
        h = np.full(n, s + P5, U64)
        at = starts.copy()
        big = np.flatnonzero(sizes >= 32)
        if len(big):
            far = big[sizes[big] > 2048]
            mid = big[sizes[big] <= 2048]
            if len(mid):
                stripes = sizes[mid] >> 5
                order = np.argsort(-stripes, kind="stable")
                mid, stripes = mid[order], stripes[order]
                p = starts[mid].copy()
                v = [np.full(len(mid), x, U64) for x in (s + P1 + P2, s + P2, s, s - P1)]
                live = len(mid)
                for k in range(int(stripes[0])):
                    live = int(np.searchsorted(-stripes, -k, "left")) if k else live
                    for lane in range(4):
                        v[lane][:live] = _round(v[lane][:live], w8[p[:live] + 8 * lane])
                    p[:live] += 32
                acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for lane in v:
                    acc = (acc ^ _round(U64(0), lane)) * P1 + P4
                h[mid] = acc
                at[mid] = p
        h += sizes.astype(U64)
        rest = sizes & 31
        n8 = rest >> 3
        for k in range(3):
            i = np.flatnonzero(n8 > k)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ _round(U64(0), w8[at[i]]), 27) * P1 + P4
            at[i] += 8
        i = np.flatnonzero(rest & 4)
        if len(i):
            h[i] = _rotl(h[i] ^ (w4[at[i]].astype(U64) * P1), 23) * P2 + P3
            at[i] += 4
        n1 = rest & 3
        for k in range(3):
            i = np.flatnonzero(n1 > k)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ (buf[at[i]].astype(U64) * P5), 11) * P1
            at[i] += 1
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        h ^= h >> U64(32)
        if len(big) and len(far):
            view = memoryview(np.ascontiguousarray(buf))
            for i in far:
                h[i] = xxhash.xxh64_intdigest(view[starts[i] : starts[i] + sizes[i]], seed)
    return h


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit values; order matters."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> U64(31))) * P2 + _rotl(b, 27) * P1 + P4
        x ^= x >> U64(29)
        x *= P3
        return x ^ (x >> U64(32))


def by_doc(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, `per[i]` of them for document i."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    e = np.cumsum(per)
    return c[e] - c[e - per]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is far faster here than hashing."""
    if not len(x):
        return x
    s = np.sort(x)
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    return s[keep]


def locate(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """searchsorted for many unsorted values: asked in sorted order, so that memory is read in order."""
    order = np.argsort(asked)
    out = np.empty(len(asked), np.int64)
    out[order] = np.searchsorted(keys, asked[order])
    return out
