"""Exact substring dedup with suffix arrays over shards of the text.

Every byte that lies in a `length`-byte string which also starts in a document of smaller doc_id is
removed. To sort the text in shards without losing a match, strings are dealt by content: each
`length`-byte window belongs to the smallest hash of the k-grams in it, so equal windows meet in one
shard; consecutive windows of one hash travel as one segment. Hashes that occur in one document only
cannot hold a match and are settled first, in blocks of a few bytes a segment. A shard sorts its
segments' suffixes by induced sorting, takes permuted common prefixes, and finds the smallest doc_id of
each group of suffixes that share `length` bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X, suffix_array as A, textops as T
from .common import stored

BITS = 54
GRAM = 24
LAST_ID = np.int64(2**63 - 1)
#: Bytes of segments sorted in one array; bounds a worker's memory.
ARRAY_BYTES = 1 << 20
_rng = np.random.default_rng(20)
BYTE_HASH = _rng.integers(0, 2**64, 256, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>"


def _powers(n: int, base: np.uint64, held: dict = {}) -> np.ndarray:  # noqa: B006
    if len(held.get(int(base), ())) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        held[int(base)] = np.cumprod(p)
    return held[int(base)][:n]


#: Bytes hashed at once, so that the arrays stay in a core's cache.
CACHE_BYTES = 1 << 17


def runs(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows, document) of each stretch of windows with one smallest k-gram hash."""
    out, at, n = [], 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + CACHE_BYTES, "right")) - 1)
        v, a, count, doc = _runs(buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at], length)
        out.append((v, a + offs[at], count, doc + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out)) if out else _runs(buf, offs, length)


def _runs(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = min(GRAM, max(1, length // 2))
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none, none
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_HASH[buf] * _powers(n, ODD), out=total[1:])
        h = (total[k:] - total[:-k]) * _powers(n - k + 1, INVERSE)
        h ^= h >> np.uint64(31)
        h *= T.P2
        h >>= np.uint64(64 - BITS)
    need = length - k + 1
    m, span = h, 1
    while span * 2 <= need:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < need:
        m = np.minimum(m[: len(m) - (need - span)], m[need - span :])
    # m[i]: the smallest hash of window i; windows over a document's edge do not count
    size = np.diff(offs)
    valid = np.maximum(size - length + 1, 0)
    edge = np.zeros(n + 1, np.int64)
    has = valid > 0
    np.add.at(edge, offs[:-1][has], 1)
    np.add.at(edge, (offs[:-1] + valid)[has], -1)
    ok = np.cumsum(edge)[: len(m)] > 0
    first = ok.copy()
    first[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
    starts_doc = offs[:-1][has]
    first[starts_doc] = True
    last = ok.copy()
    last[:-1] &= first[1:] | ~ok[1:]
    a = np.flatnonzero(first)
    count = np.flatnonzero(last) - a + 1
    with np.errstate(over="ignore"):  # smallest hashes crowd at the low end: spread them, so that shards are even
        v = (m[a] * T.P1) & np.uint64((1 << BITS) - 1)
    return v, a, count, np.searchsorted(offs, a, "right") - 1


def _read(table: pa.Table, length: int):
    """A bucket as one byte buffer (its text is bounded): bytes, offsets, doc_ids, runs."""
    b = table.combine_chunks()
    buf, offs = T.utf8(b.column("text"))
    ids = b.column("doc_id").cast(pa.int64()).combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False)
    return buf, offs, ids, runs(buf, offs, length)


def _segments(buf, ids, got, flagged, length):
    """The distinct flagged segments of a bucket in a fixed order: (hash, first byte, size, smallest doc_id), and each flagged run's place among them."""
    v, a, count, doc = (x[flagged] for x in got)
    size = count + length - 1
    content = T.xxh64(buf, a, size, 3)
    d = ids[doc]
    order = np.lexsort((d, content, v))
    new = np.ones(len(order), bool)
    new[1:] = (v[order][1:] != v[order][:-1]) | (content[order][1:] != content[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    head = order[new]
    return v[head], a[head], size[head], d[head], place


def _flags(told: pa.Table, kind: int, n: int) -> np.ndarray:
    rows = sorted((s, c, x) for k, s, c, x in zip(*(told.column(f).to_pylist() for f in ("kind", "shard", "n", "data"))) if k == kind)
    bits = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c) for _, c, x in rows]).astype(bool) if rows else np.zeros(0, bool)
    assert len(bits) == n, "answers do not fit the bucket"
    return bits


ANSWER = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
ANSWER_DDL = "bucket int, kind int, shard int, n int, data binary"


def least_ids(text: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each window of the segments (joined in `text`), the smallest id of a segment that holds the same window.

    A suffix array of the segments, each closed by a separator, is built by induced sorting; neighbours
    whose common prefix within their segments reaches `length` form a group.
    """
    n_win = size - length + 1
    at = np.cumsum(size + 1) - (size + 1)
    s = np.full(int((size + 1).sum()) + 1, 255, np.uint8)  # UTF-8 has no byte over 0xF4: 255 parts segments
    inner = np.ones(len(s) - 1, bool)
    inner[at + size] = False
    s[:-1][inner] = text + 1
    s[-1] = 0
    sa = A.suffix_array(s, 256)
    plcp = A.permuted_prefixes(s, sa, length)
    own = np.full(len(s), LAST_ID)
    is_win = np.zeros(len(s), bool)
    win = np.repeat(at, n_win) + T.ragged(n_win)
    is_win[win] = True
    own[win] = np.repeat(ids, n_win)
    apart = plcp[sa] < length  # windows lie within segments, so a prefix of `length` does too
    group_of = np.cumsum(apart)
    keep = is_win[sa]
    order, group = sa[keep], group_of[keep]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(own[order], head)
    own[order] = np.repeat(least, np.diff(np.append(head, len(order))))
    return own[win]


def suffix_dedup(docs: DataFrame, length: int = 50, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, starts, ends), a row for each row of `docs`.

    kept are the remaining bytes; starts and ends the removed runs, as byte positions. Matches never
    cross documents; strings are judged on the input. Null texts count as empty. A null doc_id comes
    after all others. Rows that repeat a doc_id are versions of one document: neither is the smaller.
    Texts shorter than `length` lose nothing. An empty table gives no rows.
    """
    if length < 8:
        raise ValueError("length must be 8 or more")
    base, size = X.bucketed(docs, bucket_bytes)
    shards = X.shard_count(docs, size)

    def ask(table: pa.Table) -> pa.Table:
        _, _, ids, (v, _, _, doc) = _read(table, length)
        order = np.lexsort((ids[doc], v))
        v, d = v[order], ids[doc][order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, int)
        last = np.append(first[1:], len(v))[: len(first)] - 1
        several = d[first] != d[last]
        v = v[first]
        cut = X.cuts(v, shards, BITS)
        own = [s for s in range(shards) if cut[s] < cut[s + 1]]
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(own), pa.int32()), "shard": pa.array(own, pa.int32()), "keys": pa.array([X.pack_sorted(v[cut[s] : cut[s + 1]]) for s in own], pa.binary()), "several": pa.array([np.packbits(several[cut[s] : cut[s + 1]]).tobytes() for s in own], pa.binary())})

    def shared(batches):
        got: dict[int, list] = {}
        for b in batches:
            for bucket, shard, keys, several in zip(*(c.to_pylist() for c in b.columns)):
                got.setdefault(shard, []).append((bucket, keys, several))
        for shard in sorted(got):
            blocks = got.pop(shard)
            every, at = X.merge([X.unpack_sorted(k) for _, k, _ in blocks])
            seen = np.zeros(len(every), np.int32)
            for i, (_, _, m) in zip(at, blocks):
                seen[i] += 1 + np.unpackbits(np.frombuffer(m, np.uint8), count=len(i))
            cols = [[b for b, _, _ in blocks], [1] * len(blocks), [shard] * len(blocks), [len(i) for i in at], [np.packbits(seen[i] > 1).tobytes() for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ANSWER)], schema=ANSWER)

    first = base.groupBy("bucket").applyInArrow(ask, "bucket int, shard int, keys binary, several binary").repartitionById(shards, "shard").mapInArrow(shared, ANSWER_DDL)

    def flagged_runs(table: pa.Table, told: pa.Table):
        buf, offs, ids, got = _read(table, length)
        keys = T.distinct(got[0])
        on = _flags(told, 1, len(keys))
        return buf, offs, ids, got, on[T.locate(keys, got[0])]

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            buf, _, ids, got, on = flagged_runs(table, told)
            v, a, size, d, _ = _segments(buf, ids, got, on, length)
            cut = X.cuts(v, shards, BITS)
            bucket = table.column("bucket")[0].as_py()
            for s in range(shards):
                w = slice(cut[s], cut[s + 1])
                if cut[s] < cut[s + 1]:
                    rows.append((bucket, s, X.pack_sorted(v[w]), size[w].astype(np.uint32).tobytes(), d[w].tobytes(), buf[T.gather(a[w], size[w])].tobytes()))
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("bucket", "shard", "keys", "sizes", "ids", "text"), cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))})

    def sort_shards(batches):
        got: dict[int, list] = {}
        for b in batches:
            for bucket, shard, *data in zip(*(c.to_pylist() for c in b.columns)):
                got.setdefault(shard, []).append((bucket, *data))
        for shard in sorted(got):
            yield _sorted_shard(shard, got.pop(shard), length)

    segments = base.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(send, "bucket int, shard int, keys binary, sizes binary, ids binary, text binary")
    second = segments.repartitionById(shards, "shard").mapInArrow(sort_shards, ANSWER_DDL)

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _out([], [], [], [], [], [])
        buf, offs, ids, got, on = flagged_runs(table, told)
        v, a, size, d, place = _segments(buf, ids, got, on, length)
        n_win = size - length + 1
        rows = sorted((s, x) for k, s, x in zip(*(told.column(f).to_pylist() for f in ("kind", "shard", "data"))) if k == 2)
        least_run, run_len = _unpack_runs([x for _, x in rows])
        least = np.repeat(least_run, run_len)
        assert len(least) == n_win.sum(), "answers do not fit the bucket"
        w_at = np.cumsum(n_win) - n_win
        # every flagged run of the bucket: its windows' smallest ids against its own document's
        a_run, c_run, doc_run = got[1][on], got[2][on], got[3][on]
        win = np.repeat(a_run, c_run) + T.ragged(c_run)
        theirs = least[np.repeat(w_at[place], c_run) + T.ragged(c_run)]
        hit = win[theirs < np.repeat(ids[doc_run], c_run)]
        step = np.zeros(len(buf) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + length, -1)
        gone = np.cumsum(step)[:-1] > 0
        return _result(table, buf, offs, gone)

    both = first.unionByName(second)
    return base.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(remove, OUT_DDL)


def _sorted_shard(shard: int, blocks: list, length: int) -> pa.RecordBatch:
    """Answers for every bucket's segments of a shard: stretches of windows with one smallest id."""
    v = [X.unpack_sorted(k) for _, k, _, _, _ in blocks]
    size = [np.frombuffer(z, np.uint32).astype(np.int64) for _, _, z, _, _ in blocks]
    ids = [np.frombuffer(i, np.int64) for _, _, _, i, _ in blocks]
    text = np.frombuffer(b"".join(t for *_, t in blocks), np.uint8)
    V, Z, D = np.concatenate(v), np.concatenate(size), np.concatenate(ids)
    at = np.cumsum(Z) - Z
    # segments alike in all bytes are sorted once, under their smallest id
    content = T.xxh64(text, at, Z, 9)
    order = np.lexsort((D, content, V))
    new = np.ones(len(order), bool)
    new[1:] = (V[order][1:] != V[order][:-1]) | (content[order][1:] != content[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    head = order[new]
    hv, hz, hd, ha = V[head], Z[head], D[head], at[head]
    n_win = hz - length + 1
    w_at = np.cumsum(n_win) - n_win
    least = np.repeat(hd, n_win)
    # a segment that is alone with its hash shares no window with others: there is nothing to sort
    twin = hv[1:] == hv[:-1]
    among = np.flatnonzero(np.concatenate([[False], twin]) | np.concatenate([twin, [False]])) if len(hv) else np.zeros(0, int)
    total, begin = np.cumsum(hz[among]), 0
    while begin < len(among):  # arrays of bounded size, never parting segments of one hash
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + ARRAY_BYTES, "right"))
        end = max(end, begin + 1)
        while end < len(among) and hv[among[end]] == hv[among[end - 1]]:
            end += 1
        w = among[begin:end]
        least[T.gather(w_at[w], n_win[w])] = least_ids(text[T.gather(ha[w], hz[w])], hz[w], hd[w], length)
        begin = end
    data, split = [], np.cumsum([len(z) for z in size])[:-1]
    for mine in np.split(kind, split):
        data.append(_pack_runs(least[T.gather(w_at[mine], n_win[mine])]))
    cols = [[b[0] for b in blocks], [2] * len(blocks), [shard] * len(blocks), [len(z) for z in size], data]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ANSWER)], schema=ANSWER)


def _pack_runs(x: np.ndarray) -> bytes:
    head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    return len(head).to_bytes(8, "little") + x[head].tobytes() + np.diff(np.append(head, len(x))).astype(np.uint32).tobytes()


def _unpack_runs(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in parts:
        n = int.from_bytes(p[:8], "little")
        values.append(np.frombuffer(p, np.int64, n, 8))
        counts.append(np.frombuffer(p, np.uint32, n, 8 + 8 * n).astype(np.int64))
    return np.concatenate(values), np.concatenate(counts)


def _out(*columns) -> pa.Table:
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "starts", "ends")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    columns = columns if len(columns) == 7 else [[]] * 7
    return pa.table({n: c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for n, c, t in zip(names, columns, types)})


def _result(table: pa.Table, buf, offs, gone) -> pa.Table:
    edge = np.zeros(len(gone) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
    first = np.flatnonzero(gone & (~before | edge[: len(gone)]))
    after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
    last = np.flatnonzero(gone & (~after | edge[1:])) + 1
    cut = np.searchsorted(first, offs)
    per = np.diff(cut)
    base = np.repeat(offs[:-1], per)
    c = np.concatenate([[0], np.cumsum(gone)])
    removed = c[offs[1:]] - c[offs[:-1]]
    left = offs - c[offs]
    kept = pa.Array.from_buffers(pa.large_binary(), len(per), [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(buf[~gone].tobytes())]).cast(pa.binary())
    spans = lambda x: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x - base))
    return _out(table.column("doc_id").cast(pa.int64()), np.diff(offs), removed.astype(np.int64), per.astype(np.int64), kept, spans(first), spans(last))
