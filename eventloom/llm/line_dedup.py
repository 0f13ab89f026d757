"""Line dedup: later repeats of runs of lines are deleted, by winnowing over line hashes.

Lines are hashed by their lower-cased words, to 128 bits. A window is the shortest stretch of lines from
a line on, or up to a line, that holds `min_words` words. Every window selects its smallest line hash (the
first of equals) as fingerprint, and only selected positions are posted: each bucket of documents sends
its distinct fingerprints, and hears which of them stand at two positions or more. For those alone it
sends the lines around the position, as far as the windows that selected it. Positions of one fingerprint
are then joined, never in pairs: all windows of a fingerprint start as one class, and each round compares
the next line to the left or right and parts the classes, until a window's ends are reached or it stands
alone. Windows still together are repeats; the first by (doc_id, place) stays. A repeated run of
`min_words` words is the union of such windows, so the windows that overlap or touch join up to the whole run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as S

from . import exchange as X, textops as T
from .common import fresh

BITS = 64
LAST_ID = np.int64(2**63 - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
ANSWER = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
ANSWER_DDL = "bucket int, kind int, shard int, n int, data binary"


class Lines:
    """Lines with a word of a batch: two hashes, words, document, and place among all lines."""

    def __init__(self, buf, offs):
        self.start, self.size, self.per_all = T.lines(buf, offs)
        words = T.Words(buf, offs, lower=True)
        cut = np.searchsorted(words.src, np.append(self.start, len(buf)))
        n = np.diff(cut)
        self.place = np.flatnonzero(n > 0)
        self.words = n[self.place]
        first, last = cut[self.place], cut[self.place + 1] - 1
        at, size = (words.at[first], words.at[last] + words.size[last] - words.at[first]) if len(self.place) else (first, first)
        self.hash, self.check = (T.xxh64(words.norm, at, size, seed) for seed in (5, 6))
        doc_all = np.repeat(np.arange(len(offs) - 1), self.per_all)
        self.doc = doc_all[self.place]
        self.per = np.bincount(self.doc, minlength=len(offs) - 1)


def windows(lines: Lines, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of every shortest window from, and up to, a line; sorted."""
    n = len(lines.place)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end_of_doc = np.cumsum(lines.per)[lines.doc]
    first_of_doc = end_of_doc - lines.per[lines.doc]
    c = np.concatenate([[0], np.cumsum(lines.words)])
    i = np.arange(n)
    to = np.searchsorted(c, c[:-1] + min_words)  # lines i..to-1 hold min_words
    ok = to <= end_of_doc
    since = np.searchsorted(c, c[1:] - min_words, "right") - 1
    back = since >= first_of_doc
    a = np.concatenate([i[ok], since[back]])
    z = np.concatenate([to[ok], i[back] + 1])
    pair = T.distinct(a * (n + 1) + z)
    return pair // (n + 1), pair % (n + 1)


def minima(h: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The position that each window selects: the first of its smallest hashes."""
    if not len(a):
        return a
    low = np.minimum.reduceat(np.append(h, np.uint64(2**64 - 1)), np.stack([a, z], 1).ravel())[::2]
    keys = T.distinct(h)
    wide = len(h) + 1
    places = np.sort(np.searchsorted(keys, h) * wide + np.arange(len(h)))
    return places[np.searchsorted(places, np.searchsorted(keys, low) * wide + a)] % wide


class _Sums:
    """Hashes of stretches of lines from running sums; only for telling stretches of one bucket apart."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        with np.errstate(over="ignore"):
            power, self.unpower = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
            power[1:], self.unpower[1:] = ODD, INVERSE
            power, self.unpower = np.cumprod(power), np.cumprod(self.unpower)
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n])])

    def of(self, a, z):
        with np.errstate(over="ignore"):
            return (self.total[z] - self.total[a]) * self.unpower[a]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order, group by group; the number of each row's group)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for i, k in enumerate(keys):
        s = k[order]
        new[1:] = s[1:] != s[:-1] if not i else new[1:] | (s[1:] != s[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, number


class Bucket:
    """A bucket's documents slice by slice, with all their windows and the positions that these select."""

    def __init__(self, table: pa.Table, bucket: str, min_words: int):
        self.parts = []
        a, z, base = [], [], 0
        ids, hashes, checks, doc, place = [], [], [], [], []
        for k, b in enumerate(T.slices(table.combine_chunks().to_batches())):
            buf, offs = T.utf8(b.column(b.schema.get_field_index("text")))
            lines = Lines(buf, offs)
            own = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            wa, wz = windows(lines, min_words)
            self.parts.append((b, buf, offs, lines, len(wa)))
            a.append(wa + base)
            z.append(wz + base)
            ids.append(own[lines.doc])
            hashes.append(lines.hash)
            checks.append(lines.check)
            doc.append(lines.doc + (k << 32))
            place.append(lines.place)
            base += len(lines.place)
        join = lambda x, t=np.int64: np.concatenate(x).astype(t, copy=False) if x else np.zeros(0, t)
        self.a, self.z = join(a), join(z)
        self.ids, self.doc, self.place = join(ids), join(doc), join(place)
        self.hash, self.check = join(hashes, np.uint64), join(checks, np.uint64)
        self.at = minima(self.hash, self.a, self.z)
        self.number = table.column(bucket)[0].as_py() if table.num_rows else 0

    def posted(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints, and which stand at several positions here."""
        h = np.sort(self.hash[T.distinct(self.at)])
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.diff(np.append(first, len(h))) > 1

    def contexts(self, shared: np.ndarray):
        """Of the windows at `shared` fingerprints: those of equal surroundings once.

        Returns the windows (ordered by selecting position), each window's context and its place among the
        context's windows, and of every context one representative position with its reach and smallest doc_id.
        """
        keys, _ = self.posted()
        on = np.flatnonzero(shared[T.locate(keys, self.hash[self.at])]) if len(keys) else np.zeros(0, np.int64)
        on = on[np.lexsort((self.z[on], self.a[on], self.at[on]))]
        at = self.at[on]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(on) else np.zeros(0, np.int64)
        per = np.diff(np.append(head, len(on)))
        if not len(on):
            return on, on, on, on, on, on, on, on
        p = at[head]
        lo, hi = np.minimum.reduceat(self.a[on], head), np.maximum.reduceat(self.z[on], head)
        with np.errstate(over="ignore"):
            shape = np.add.reduceat(T.mix((at - self.a[on]).astype(np.uint64), (self.z[on] - at).astype(np.uint64)), head)
        order, number = _groups(self.hash[p], _Sums(self.hash).of(lo, hi), _Sums(self.check).of(lo, hi), shape, p - lo, hi - p)
        lead = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1]]))
        one = order[lead]
        least = np.minimum.reduceat(self.ids[p[order]], lead)
        return on, np.repeat(number, per), T.ragged(per), p[one], lo[one], hi[one], per[one], least

    def reach(self, on: np.ndarray, one_head: np.ndarray, per: np.ndarray) -> np.ndarray:
        """How far the contexts' windows go, left and right, in order."""
        w = on[T.gather(one_head, per)]
        return np.stack([self.at[w] - self.a[w], self.z[w] - self.at[w] - 1], 1).astype(np.uint32)


def extend(fp: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Classes of windows that are alike line by line: numbers, equal for equal windows; -1 for windows that stand alone.

    Window i reaches `left[i]` lines before and `right[i]` after its fingerprint, which is line at[i] of the
    hashes. All windows of a fingerprint and reach start as one class, and every round compares one more line.
    """
    out = np.full(len(fp), -1, np.int64)
    live = np.arange(len(fp))
    key = [fp, left.astype(np.uint64), right.astype(np.uint64), checks[at]]
    used = 0
    rounds = [0, *(s * k for k in range(1, int(max(left.max(), right.max())) + 1) for s in (-1, 1))] if len(fp) else []
    cls = np.zeros(len(fp), np.int64)
    for step in rounds:
        if step:
            far = (left if step < 0 else right)[live] >= abs(step)
            if not far.any():
                continue
            line = at[live] + np.where(far, step, 0)
            order, number = _groups(cls[live], hashes[line], checks[line])
        else:
            order, number = _groups(*key)
        size = np.bincount(number)
        cls[live] = number
        together = size[number] > 1
        live = live[together]
        if not len(live):
            break
        done = (left[live] <= abs(step)) & (right[live] <= (step if step > 0 else abs(step) - 1 if step else 0))
        if done.any():
            ended, fresh_number = np.unique(cls[live[done]], return_inverse=True)
            out[live[done]] = used + fresh_number
            used += len(ended)
            live = live[~done]
            if not len(live):
                break
    return out


def _columns(rows: list, names: dict[str, pa.DataType]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(names.items(), cols)})


def line_dedup(docs: DataFrame, min_words: int = 50, bucket_bytes: int = 8 << 20) -> DataFrame:
    """All columns of `docs`, and kept_text, n_lines, n_removed, words_removed, n_words, removed (array of line numbers from 0).

    A line is deleted if it lies in a run of consecutive lines with words, `min_words` words or more in
    all, that also stands earlier: in a document of smaller doc_id, or further up in the same one. Lines
    without words do not part a run and stay. The order is doc_id, then place; a null doc_id comes last;
    rows that repeat a doc_id are versions of one document, so none is the other's repeat. Null texts
    stay null, empty ones empty. A text may be of any length: its bucket holds it whole. An empty table
    gives no rows. Columns of `docs` keep their names; the new ones replace columns of the same name
    (`clean` keeps them).
    """
    new = ["kept_text", "n_lines", "n_removed", "words_removed", "n_words", "removed"]
    bucket = fresh(docs, "bucket")
    rows = docs.drop(*new)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = X.bucket_count(docs.sparkSession, size, bucket_bytes)
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_buckets)).cast("int"))
    shards = X.shard_count(docs, size)
    binary = pa.binary()

    def ask(table: pa.Table) -> pa.Table:
        b = Bucket(table, bucket, min_words)
        k, several = b.posted()
        cut = X.cuts(k, shards, BITS)
        return _columns([(b.number, s, X.pack_sorted(k[cut[s] : cut[s + 1]]), np.packbits(several[cut[s] : cut[s + 1]]).tobytes()) for s in np.flatnonzero(np.diff(cut)).tolist()], {"bucket": pa.int32(), "shard": pa.int32(), "keys": binary, "several": binary})

    def shared(batches):
        for shard, blocks in X.by_shard(batches):
            every, at = X.merge([X.unpack_sorted(k) for _, k, _ in blocks])
            seen = np.zeros(len(every), np.int32)
            for i, (_, _, m) in zip(at, blocks):
                seen[i] += 1 + np.unpackbits(np.frombuffer(m, np.uint8), count=len(i))
            cols = [[b for b, _, _ in blocks], [1] * len(blocks), [shard] * len(blocks), [len(i) for i in at], [np.packbits(seen[i] > 1).tobytes() for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, ANSWER)], schema=ANSWER)

    first = rows.groupBy(bucket).applyInArrow(ask, "bucket int, shard int, keys binary, several binary").repartitionById(shards, "shard").mapInArrow(shared, ANSWER_DDL)

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if table.num_rows:
            b = Bucket(table, bucket, min_words)
            on, ctx, nth, p, lo, hi, per, least = b.contexts(X.flags(told, 1))
            heads = np.flatnonzero(nth == 0)
            head = np.zeros(len(p), np.int64)
            head[ctx[heads]] = heads
            cut = X.cuts(b.hash[p], shards, BITS)
            for s in np.flatnonzero(np.diff(cut)).tolist():
                w = slice(cut[s], cut[s + 1])
                lines = T.gather(lo[w], hi[w] - lo[w])
                out.append((b.number, s, X.pack_sorted(b.hash[p[w]]), least[w].tobytes(), np.stack([p[w] - lo[w], hi[w] - lo[w], per[w]]).astype(np.uint32).tobytes(), b.reach(on, head[w], per[w]).tobytes(), b.hash[lines].tobytes() + b.check[lines].tobytes()))
        return _columns(out, {"bucket": pa.int32(), "shard": pa.int32(), "keys": binary, "ids": binary, "sizes": binary, "reach": binary, "lines": binary})

    def join(batches):
        for shard, blocks in X.by_shard(batches):
            fp = [X.unpack_sorted(k) for _, k, *_ in blocks]
            ids = np.concatenate([np.frombuffer(i, np.int64) for _, _, i, *_ in blocks])
            before, size, per = np.concatenate([np.frombuffer(x, np.uint32).reshape(3, -1) for _, _, _, x, *_ in blocks], axis=1).astype(np.int64)
            reach = np.concatenate([np.frombuffer(x, np.uint32).reshape(-1, 2) for *_, x, _ in blocks]).astype(np.int64)
            halves = [np.frombuffer(x, np.uint64).reshape(2, -1) for *_, x in blocks]
            hashes, checks = (np.concatenate([x[i] for x in halves]) for i in (0, 1))
            at = np.repeat(np.cumsum(size) - size + before, per)
            d = np.repeat(ids, per)
            cls = extend(np.repeat(np.concatenate(fp), per), reach[:, 0], reach[:, 1], at, hashes, checks)
            late = np.zeros(len(cls), bool)
            some = np.flatnonzero(cls >= 0)
            if len(some):
                least = np.full(int(cls.max()) + 1, LAST_ID)
                np.minimum.at(least, cls[some], d[some])
                late[some] = d[some] > least[cls[some]]
            ends = np.cumsum([int(per[a:z].sum()) for a, z in zip(*(lambda e: (e[:-1], e[1:]))(np.cumsum([0, *map(len, fp)])))])
            mine = np.split(late, ends[:-1])
            cols = [[b[0] for b in blocks], [2] * len(blocks), [shard] * len(blocks), [len(m) for m in mine], [np.packbits(m).tobytes() for m in mine]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, ANSWER)], schema=ANSWER)

    sent = rows.groupBy(bucket).cogroup(first.groupBy("bucket")).applyInArrow(send, "bucket int, shard int, keys binary, ids binary, sizes binary, reach binary, lines binary")
    second = sent.repartitionById(shards, "shard").mapInArrow(join, ANSWER_DDL)
    out_schema = S.StructType([*rows.drop(bucket).schema.fields, S.StructField("kept_text", S.StringType()), *(S.StructField(c, S.LongType()) for c in new[1:5]), S.StructField("removed", S.ArrayType(S.IntegerType()))])

    def apply(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], schema=_arrow(out_schema))
        b = Bucket(table, bucket, min_words)
        on, ctx, nth, *_, per, _ = b.contexts(X.flags(told, 1))
        elsewhere = X.flags(told, 2)
        assert len(elsewhere) == per.sum(), "answers do not fit the bucket"
        late = np.zeros(len(b.a), bool)
        if len(on):
            late[on] = elsewhere[(np.cumsum(per) - per)[ctx] + nth] | b_late(b, on)
        step = np.zeros(len(b.hash) + 1, np.int64)
        np.add.at(step, b.a[late], 1)
        np.add.at(step, b.z[late], -1)
        gone = np.cumsum(step)[:-1] > 0
        out, begin = [], 0
        for batch, buf, offs, lines, _ in b.parts:
            n = len(lines.place)
            out.append(_batch(batch, buf, offs, lines, gone[begin : begin + n], bucket))
            begin += n
        return pa.Table.from_batches(out)

    return rows.groupBy(bucket).cogroup(first.unionByName(second).groupBy("bucket")).applyInArrow(apply, out_schema)


def b_late(b: Bucket, on: np.ndarray) -> np.ndarray:
    """Which of the windows `on` repeat one of the same bucket: all but the first by (doc_id, place), versions of one document aside."""
    a, z = b.a[on], b.z[on]
    _, same = _groups(_Sums(b.hash).of(a, z), _Sums(b.check).of(a, z), z - a)
    ids, doc, place = b.ids[a], b.doc[a], b.place[a]
    order = np.lexsort((place, doc, ids, same))
    g, i, r = same[order], ids[order], doc[order]
    first = np.concatenate([[True], g[1:] != g[:-1]])
    row_first = first.copy()
    row_first[1:] |= r[1:] != r[:-1]
    lead = np.flatnonzero(first)
    first_id = np.repeat(i[lead], np.diff(np.append(lead, len(g))))
    late = np.zeros(len(on), bool)
    late[order] = ~((i == first_id) & row_first)
    return late


def _arrow(schema: S.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(b, buf, offs, lines: Lines, gone, bucket) -> pa.RecordBatch:
    n_docs = len(offs) - 1
    text_at = b.schema.get_field_index("text")
    texts = b.column(text_at).to_pylist()
    gone_all = np.zeros(len(lines.start), bool)
    gone_all[lines.place[gone]] = True
    first = np.cumsum(lines.per_all) - lines.per_all
    n_gone = T.by_doc(gone_all, lines.per_all)
    removed: list[list[int]] = [[]] * n_docs
    for d in np.flatnonzero(n_gone):
        r = range(first[d], first[d] + lines.per_all[d])
        texts[d] = b"\n".join(bytes(buf[lines.start[i] : lines.start[i] + lines.size[i]]) for i in r if not gone_all[i]).decode()
        removed[d] = np.flatnonzero(gone_all[first[d] : first[d] + lines.per_all[d]]).tolist()
    columns = {f.name: c for f, c in zip(b.schema, b.columns) if f.name != bucket}
    columns["kept_text"] = pa.array(texts, pa.string())
    for name, v in (("n_lines", lines.per_all), ("n_removed", n_gone), ("words_removed", T.by_doc(np.where(gone, lines.words, 0), lines.per)), ("n_words", T.by_doc(lines.words, lines.per))):
        columns[name] = pa.array(np.asarray(v, np.int64))
    columns["removed"] = pa.array(removed, pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)


def clean(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """`docs` without later repeats: kept_text in place of text, n_chars recounted where text changed; documents that lose all their words go.

    All other columns come through untouched, under any name. Null, empty and long texts, ties, repeated
    rows and empty tables are as in `line_dedup`.
    """
    carried = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("carried"))
    out = line_dedup(carried, min_words).where("n_removed = 0 or words_removed < n_words")
    columns = []
    for c in docs.columns:
        own = F.col("carried").getField(c)
        if c == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(own).cast(docs.schema[c].dataType)
        columns.append((F.col("kept_text") if c == "text" else own).alias(c))
    return out.select(*columns)
