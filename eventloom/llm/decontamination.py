"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words. Passages and benchmark items are TF-IDF vectors
over the items' terms, with document frequencies counted over all passages; a randomised SVD, its sums
taken in Spark, gives the latent space. Passages near an item by cosine are candidates; a candidate is
a leak if enough of the item, in order, stands around the passage (longest common subsequence), along
with its telling words and its close (the answer), so that paraphrases count and chance does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .common import documents, stored, without

#: Share of all passages from which on a term is common: it stays out of the vectors, whatever the corpus' size.
COMMON = 0.01
#: Cosines held at once by a task.
COSINES = 1 << 20
HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int64()), ("item_words", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("doc_words", pa.int64())])
HIT_DDL = "doc_id long, item_id long, cosine double, lcs long, item_words long, first_word long, last_word long, doc_words long"


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = where.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Items:
    """Benchmark items as sequences of term numbers."""

    def __init__(self, rows: list):
        texts = pa.array([r["text"] for r in rows], pa.string())
        words = T.Words(*T.utf8(texts), lower=True)
        h = words.hashes(23)
        self.ids = [r["item_id"] for r in rows]
        self.terms = T.distinct(h)
        seq = np.searchsorted(self.terms, h)
        self.seqs = np.split(seq, np.cumsum(words.per_doc)[:-1]) if len(rows) else []

    def weigh(self, df: np.ndarray, n: int) -> None:
        """IDF weights. Common terms have none, unless an item has too little without them.

        An item whose common terms hold over half of its weight keeps all of its terms, and they enter the
        vectors of all passages. `own` has each item's weights of its distinct terms, which no other item changes.
        """
        full = np.maximum(np.log((n + 2) / (df + 1)), 0.1).astype(np.float32)
        telling = df <= COMMON * n
        used = telling.copy()
        self.own = []
        rows, terms, values = [], [], []
        for s in self.seqs:
            t = np.unique(s)
            mine = telling[t] if 2 * full[t][telling[t]].sum() >= full[t].sum() else np.ones(len(t), bool)
            used[t[mine]] = True
            self.own.append(np.where(mine, full[t], np.float32(0)))
        self.weight = np.where(used, full, np.float32(0))
        for i, s in enumerate(self.seqs):
            t, c = np.unique(s, return_counts=True)
            v = np.sqrt(c) * self.weight[t]
            rows.append(np.full(len(t), i))
            terms.append(t)
            values.append((v / max(float(np.linalg.norm(v)), 1e-9)).astype(np.float32))
        self.row, self.term, self.value = (np.concatenate(x) if x else np.zeros(0) for x in (rows, terms, values))

    def times(self, m: np.ndarray) -> np.ndarray:
        """The items' unit vectors (items x terms, held sparse) times a matrix."""
        out = np.zeros((len(self.seqs), m.shape[1]), m.dtype)
        for a in range(0, len(self.row), 1 << 16):
            w = slice(a, a + (1 << 16))
            np.add.at(out, self.row[w], m[self.term[w]] * self.value[w, None])
        return out

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.terms), y.shape[1]), y.dtype)
        for a in range(0, len(self.row), 1 << 16):
            w = slice(a, a + (1 << 16))
            np.add.at(out, self.term[w], y[self.row[w]] * self.value[w, None])
        return out


def _sequences(base: DataFrame, terms: np.ndarray) -> DataFrame:
    """Each document's words that are terms of the items: their places and term numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("doc_words", pa.int64()), ("places", pa.binary()), ("terms", pa.binary())])
    held = base.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        keys = held.value
        slot = np.zeros(1 << 16, bool)
        slot[(keys >> np.uint64(48)).astype(np.int64)] = True
        for b in T.slices(batches, limit=1 << 20):
            words = T.Words(*T.utf8(b.column(1)), lower=True)
            h = words.hashes(23)
            some = np.flatnonzero(slot[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(T.locate(keys, h[some]), max(len(keys) - 1, 0))
            ok = keys[at] == h[some] if len(keys) else np.zeros(len(some), bool)
            some, at = some[ok], at[ok].astype(np.uint32)
            place = (some - words.first[words.doc[some]]).astype(np.uint32)
            cut = np.searchsorted(words.doc[some], np.arange(len(words.per_doc) + 1))
            rows = [(place[i:j].tobytes(), at[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.per_doc.astype(np.int64)), *(pa.array(c, pa.binary()) for c in (zip(*rows) if rows else ((), ())))], schema=schema)

    return base.mapInArrow(run, "doc_id long, doc_words long, places binary, terms binary")


class Passages:
    """The passages of a batch of sequences that hold a telling term, as sparse rows."""

    def __init__(self, batch: pa.RecordBatch, weight: np.ndarray | None, span: int):
        step = span // 2
        cut = lambda c: (np.frombuffer(b"".join(c), np.uint32).astype(np.int64), np.array([len(x) // 4 for x in c], np.int64))
        self.places, self.per = cut(batch.column(2).to_pylist())
        self.terms, _ = cut(batch.column(3).to_pylist())
        n_words = batch.column(1).to_numpy()
        doc = np.repeat(np.arange(len(self.per)), self.per)
        last = np.maximum(-(-(n_words - span) // step), 0)  # number of a document's last passage
        self.total = int((last + 1).sum())
        use = np.arange(len(doc)) if weight is None else np.flatnonzero(weight[self.terms] > 0)
        self.telling, self.telling_at = self.terms[use], (doc[use] << 34) | self.places[use]
        p = np.minimum(self.places[use] // step, last[doc[use]])
        before = np.flatnonzero((p > 0) & (self.places[use] < (p - 1) * step + span))
        rows_doc = np.concatenate([doc[use], doc[use][before]])
        rows_p = np.concatenate([p, p[before] - 1])
        term = np.concatenate([self.terms[use], self.terms[use][before]])
        key = (rows_doc << 34) | rows_p
        order = np.lexsort((term, key))
        key, term = key[order], term[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (term[1:] != term[:-1])
        head = np.flatnonzero(new)
        self.tf = np.diff(np.append(head, len(key)))
        key, self.term = key[head], term[head]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        self.first = np.flatnonzero(first)
        self.doc, self.number = key[self.first] >> 34, key[self.first] & ((1 << 34) - 1)
        if weight is not None and len(self.first):
            v = np.sqrt(self.tf) * weight[self.term]
            norm = np.sqrt(np.add.reduceat(v * v, self.first))
            self.value = (v / np.repeat(norm, np.diff(np.append(self.first, len(v))))).astype(np.float32)

    def times(self, m: np.ndarray) -> np.ndarray:
        return np.add.reduceat(m[self.term] * self.value[:, None], self.first) if len(self.first) else np.zeros((0, m.shape[1]), np.float32)

    def transposed_times(self, y: np.ndarray, out: np.ndarray) -> None:
        """out += Aᵀ y."""
        if not len(self.first):
            return
        row = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.term))))
        order = np.argsort(self.term, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], self.term[order][1:] != self.term[order][:-1]]))
        for i in range(0, len(head), 4096):
            z = head[i + 4096] if i + 4096 < len(head) else len(order)
            o = order[head[i] : z]
            out[self.term[o][head[i : i + 4096] - head[i]]] += np.add.reduceat(y[row[o]] * self.value[o, None], head[i : i + 4096] - head[i])


def _pieces(batches, rows: int = 100):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _summed(seqs: DataFrame, make, shape: tuple[int, int], blocks: int = 16) -> np.ndarray:
    """The sum over all tasks of the matrix that `make` fills from a task's batches.

    It is added up in Spark by blocks of rows, in two steps: of n tasks, some square root of n add up theirs first.
    """
    groups = max(1, round(seqs.rdd.getNumPartitions() ** 0.5))
    edges = np.linspace(0, shape[0], blocks + 1).astype(int)

    def run(batches):
        out = np.zeros(shape, np.float32)
        for b in _pieces(batches):
            make(b, out)
        group = TaskContext.get().partitionId() % groups
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array([group] * blocks, pa.int32()), pa.array([out[edges[i] : edges[i + 1]].astype(np.float64).tobytes() for i in range(blocks)], pa.binary())], names=["block", "g", "m"])

    def add(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                got[k] = got.get(k, 0) + np.frombuffer(m)
        for k, m in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["block", "g", "m"])

    ddl = "block int, g int, m binary"
    parts = seqs.mapInArrow(run, ddl).repartition(blocks * groups, "block", "g").mapInArrow(add, ddl).repartition(blocks, "block").mapInArrow(add, ddl).collect()
    out = np.zeros(shape)
    for r in parts:
        out[edges[r["block"]] : edges[r["block"] + 1]] = np.frombuffer(bytes(r["m"])).reshape(-1, shape[1])
    return out


def latent_space(seqs: DataFrame, items: Items, span: int, rank: int, seed: int = 0) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF passages and items, the items weighing as much as all passages."""
    d = len(items.terms)
    k = max(1, min(rank, d, len(items.seqs) + 8))
    omega = np.random.default_rng(seed).normal(size=(d, min(d, k + 8))).astype(np.float32)
    weight = items.weight
    bc = seqs.sparkSession.sparkContext.broadcast((omega, weight))

    def reach(b, out):
        m, w = bc.value
        p = Passages(b, w, span)
        p.transposed_times(p.times(m), out)

    g = _summed(seqs, reach, omega.shape)
    own = items.transposed_times(items.times(omega))
    g += own * (np.linalg.norm(g) / max(np.linalg.norm(own), 1e-9))
    q = np.ascontiguousarray(np.linalg.qr(g)[0], dtype=np.float32)
    bq = seqs.sparkSession.sparkContext.broadcast((q, weight))

    def gram(b, out):
        m, w = bq.value
        y = Passages(b, w, span).times(m)
        out += y.T @ y

    c = _summed(seqs, gram, (q.shape[1], q.shape[1]), blocks=1)
    e = items.times(q)
    e = e.T @ e
    c += e * (max(np.trace(c), 1e-9) / max(np.trace(e), 1e-9))
    _, u = np.linalg.eigh(c)
    return np.ascontiguousarray(q @ u[:, ::-1][:, :k], dtype=np.float32)


def leaks(docs: DataFrame, benchmark: DataFrame, span: int = 64, rank: int = 256, cosine: float = 0.35, match: float = 0.65, telling: float = 0.5) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, item_words, first_word, last_word, doc_words): the items that a document holds, wholly or nearly.

    A leak needs `match` of the item's words in order around a passage, `telling` of its words by IDF
    weight there, and half of its last fifth. Null and empty texts, on either side, match nothing.
    Rows that repeat a doc_id, or item_id, are each looked at, and give equal rows once. Null ids stay
    null. Empty tables give no rows. Words are compared lower-cased. Texts may be of any length; of several
    passages that hold an item, the longest subsequence counts, then the cosine, then the first. All items
    share one latent space; they are held by the driver and every task, so a benchmark must fit in memory.
    Other columns are not looked at.
    """
    base = documents(docs)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    got = sorted(rows.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
    found = _search(base, Items(got), span, rank, cosine, match, telling)
    return found.groupBy("doc_id", "item_id").agg(*(F.max_by(c, F.struct("lcs", "cosine", F.negative("first_word"))).alias(c) for c in HIT.names[2:]))


def _enough_weight(p: Passages, passage: np.ndarray, item: np.ndarray, step: int, span: int, sizes: np.ndarray, held_terms: np.ndarray, held_weight: np.ndarray, n_terms: int, least: np.ndarray) -> np.ndarray:
    """Which candidates have the least weight of their item's distinct terms around the passage; others can't be leaks."""
    base, a = p.doc[passage] << 34, p.number[passage] * step
    lo = np.searchsorted(p.telling_at, base + np.maximum(a - sizes[item], 0))
    per = np.searchsorted(p.telling_at, base + a + span + sizes[item]) - lo
    asked = np.repeat(item, per) * n_terms + p.telling[T.gather(lo, per)]
    pair = np.repeat(np.arange(len(item)), per)
    at = np.minimum(np.searchsorted(held_terms, asked), len(held_terms) - 1)
    ok = held_terms[at] == asked
    both = T.distinct(pair[ok] * len(held_terms) + at[ok])
    got = np.bincount(both // len(held_terms), held_weight[both % len(held_terms)], len(item))
    return got >= least[item] * (1 - 1e-5)


def _search(base: DataFrame, items: Items, span: int, rank: int, cosine: float, match: float, telling: float) -> DataFrame:
    spark = base.sparkSession
    if not len(items.terms):
        return spark.createDataFrame([], HIT_DDL)
    seqs = stored(_sequences(base, items.terms), "term-places")

    def count(b, out):
        p = Passages(b, None, span)
        out[: len(items.terms), 0] += np.bincount(p.term, minlength=len(items.terms))
        out[len(items.terms), 0] += p.total

    df = _summed(seqs, count, (len(items.terms) + 1, 1))[:, 0]
    items.weigh(df[:-1], int(df[-1]))
    space = latent_space(seqs, items, span, rank)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    held = spark.sparkContext.broadcast((items.weight, items.own, space, unit(items.times(space)).astype(np.float32), items.ids, items.seqs))
    step = span // 2

    def run(batches):
        weight, own, m, vectors, ids, seq = held.value
        total = np.array([w.sum() for w in own])
        held_weight = np.concatenate(own)
        sizes = np.array([len(s) for s in seq], np.int64)
        held_terms = np.concatenate([j * len(weight) + np.unique(s) for j, s in enumerate(seq)])
        for b in _pieces(batches):
            p = Passages(b, weight, span)
            found: dict[tuple[int, int], tuple] = {}
            begin = np.cumsum(p.per) - p.per
            names, n_words = b.column(0).to_pylist(), b.column(1).to_pylist()
            v = unit(p.times(m))
            block = max(16, COSINES // len(vectors))
            for i in range(0, len(v), block):
                cos = v[i : i + block] @ vectors.T
                row, item = np.nonzero(cos >= cosine)
                ok = _enough_weight(p, i + row, item, step, span, sizes, held_terms, held_weight, len(weight), telling * total)
                row, item = row[ok], item[ok]
                for r, j in zip(row.tolist(), item.tolist()):
                    d, c = int(p.doc[i + r]), float(cos[r, j])
                    s = seq[j]
                    a = int(p.number[i + r]) * step
                    lo, hi = begin[d], begin[d] + p.per[d]
                    w = slice(lo + np.searchsorted(p.places[lo:hi], a - len(s)), lo + np.searchsorted(p.places[lo:hi], a + span + len(s)))
                    near, at = p.terms[w], p.places[w]
                    there = np.isin(s, near)
                    if there.sum() < match * len(s) or own[j][np.isin(np.unique(s), near)].sum() < telling * total[j]:
                        continue
                    if 2 * there[-max(2, -(-len(s) // 5)) :].sum() < min(len(s), max(2, -(-len(s) // 5))):
                        continue
                    mine = np.isin(near, s)
                    n = lcs(s, near[mine])
                    if n < match * len(s):
                        continue
                    old = found.get((d, j))
                    if old is None or (n, c, -a) > (old[1], old[0], -old[3]):
                        found[d, j] = (c, n, len(s), int(at[mine][0]), int(at[mine][-1]))
            if found:
                cols = list(zip(*((names[d], ids[j], *x, n_words[d]) for (d, j), x in sorted(found.items()))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, HIT)], schema=HIT)

    return seqs.mapInArrow(run, HIT_DDL)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents of `docs` that hold no benchmark item, all columns kept under any names; rows of null doc_id are kept."""
    return without(docs, leaks(docs, benchmark).where("doc_id is not null").select("doc_id"))
