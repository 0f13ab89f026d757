"""Quality classification by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its hashed words, the shapes of its words, and terms for how repetitive, noisy and
shouted it is. Terms are weighted by TF-IDF over the whole corpus; the singular vectors of a bounded
labelled sample span the latent space. The sample's vectors are broadcast (their number and size are
bounded by parameters); each document is compared with all of them by blocked cosine products, and its
nearest neighbours vote, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .common import documents, fold
from .quality_rules import later_copies

WORDS, SHAPES = 1024, 64
#: Upper edges of the levels of each measure of a text.
LEVELS = {
    "repeated": (0.0, 0.02, 0.1, 0.3, 0.6, 9.0),
    "symbols": (0.0, 0.02, 0.1, 0.3, 1.0, 9e9),
    "capitals": (0.02, 0.1, 0.3, 0.6, 9.0),
    "marks": (0.02, 0.1, 0.25, 0.6, 9e9),
    "distinct": (0.1, 0.25, 0.45, 0.6, 9.0),
    "words": (0.0, 10, 50, 200, 1000, 9e15),
}
DIMS = WORDS + SHAPES + sum(map(len, LEVELS.values()))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~=+{}[]\\_")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Term frequencies, documents x DIMS: words and shapes as dampened shares, measures as their level."""
    n = len(offs) - 1
    words = T.Words(buf, offs)
    per, doc = words.per_doc, words.doc
    out = np.zeros((n, DIMS), np.float32)
    h = words.hashes(17)
    lower = T.Words(buf, offs, lower=True).hashes(17)
    count = np.bincount(doc * WORDS + (lower % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, :WORDS] = 0.5 * np.log1p(count) / np.maximum(np.sqrt(per), 1)[:, None]
    ends = words.at + words.size
    of = lambda lut: (lambda c: c[ends] - c[words.at])(np.concatenate([[0], np.cumsum(lut[words.norm], dtype=np.int64)]))
    sym, mark, up, let, dig = (of(x) for x in (_SYMBOL, _MARK, _UPPER, _LETTER, _DIGIT))
    shape = (sym > 0) * 1 + (mark > 1) * 2 + ((up > 1) & (2 * up > let)) * 4 + (let == 0) * 8 + (dig > 0) * 16 + (words.size > 20) * 32
    share = np.bincount(doc * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) / np.maximum(per, 1)[:, None]
    out[:, WORDS : WORDS + SHAPES] = np.sqrt(share)
    sh, _, per_sh = words.shingles(3)
    twice, _ = later_copies(sh, np.repeat(np.arange(n), per_sh))
    _, again = later_copies(h, doc)
    total = np.maximum(per, 1)
    add = lambda x: T.by_doc(x, per)
    measures = {"repeated": T.by_doc(twice, per_sh) / np.maximum(per_sh, 1), "symbols": add(sym) / total, "capitals": add(up) / np.maximum(add(let), 1), "marks": add(mark) / total, "distinct": np.where(per < 20, 1.0, 1 - add(again) / total * (np.minimum(total, 400) / 400) ** -0.3 * 0.8), "words": per}
    at = WORDS + SHAPES
    for name, edges in LEVELS.items():
        level = np.searchsorted(np.array(edges), measures[name], "left")
        out[np.arange(n), at + np.minimum(level, len(edges) - 1)] = 0.7
        at += len(edges)
    return out


def _slices(batches):
    return T.slices(batches, limit=2 << 20)


def _frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term occurs: over all documents, summed in Spark."""

    def run(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for b in _slices(batches):
            total += (features(*T.utf8(b.column(1))) > 0).sum(0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], total]))], names=["term", "n"])

    df = np.zeros(DIMS + 1, np.int64)
    for term, n in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term + 1] = n
    return int(df[0]), df[1:]


def _examples(base: DataFrame, labels: DataFrame, folds: int, held_fold: int, per_class: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """Term frequencies and labels of at most per_class labelled documents of either label, and all labels' counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(fold("doc_id", folds) != held_fold).distinct()
    counts = {r[0]: r[1] for r in own.groupBy("quality").count().collect()}
    if not counts:
        return np.zeros((0, DIMS), np.float32), np.zeros(0, int), counts
    share = F.coalesce(*[F.when(F.col("quality") == k, F.lit(min(1.0, 1.1 * per_class / n + 1e-9))) for k, n in counts.items()])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = own.withColumn("draw", draw).where(F.col("draw") < share)
    pick = F.broadcast(few)  # about 2.2 * per_class rows at most

    def run(batches):
        for b in _slices(batches):
            x = features(*T.utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "draw", "x"])

    rows = base.join(pick, "doc_id").select("doc_id", "text", "quality", "draw").mapInArrow(run, "doc_id long, quality int, draw double, x binary").groupBy("doc_id", "quality", "draw").agg(F.min("x").alias("x")).collect()
    out, used = [], {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["doc_id"], r["quality"], bytes(r["x"]))):
        used[r["quality"]] = used.get(r["quality"], 0) + 1
        if used[r["quality"]] <= per_class:
            out.append(r)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in out]).reshape(-1, DIMS)
    return x, np.array([r["quality"] for r in out], int), counts


def votes(cos: np.ndarray, k: int) -> np.ndarray:
    """Each row's votes: the eighth power of its k greatest cosines, and of all that equal the last of them; 0 for others."""
    last = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
    w = np.where(cos >= last, np.maximum(cos, np.float32(1e-3)), np.float32(0))
    for _ in range(3):
        w *= w
    return w


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, per_class: int = 1500, rank: int = 48, neighbours: int = 15, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of `docs`.

    At most per_class labelled documents of either label, outside the held-out fold, are the neighbours;
    votes are weighted back to the labels' own shares. Null and empty texts are scored like others, by
    their measures. Without any label the score is 0.5. Rows that repeat a doc_id are scored each, and
    one of them is a neighbour if it is labelled; labels of null doc_id or quality are passed over. All
    neighbours that tie with the last one vote. Texts of any length are read whole. An empty table gives
    no rows.
    """
    base = documents(docs)
    n_docs, df = _frequencies(base)
    idf = np.log((n_docs + 1) / (df + 1)).astype(np.float32) + 0.3
    x, y, counts = _examples(base, labels, folds, held_fold, per_class)
    if not len(y):
        return base.select("doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    x = x * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    space = np.ascontiguousarray(vt[: min(rank, len(vt))].T * idf[:, None], dtype=np.float32)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    latent = unit(x @ (space / idf[:, None])).astype(np.float32)
    shown = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(k, 0) / shown[k] for k in y], np.float32)
    weight = (weight / weight.max()) ** 0.5
    held = docs.sparkSession.sparkContext.broadcast((space, latent, y.astype(np.float32), weight))
    k = min(neighbours, len(y))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        space, latent, label, weight = held.value
        for b in _slices(batches):
            v = unit(features(*T.utf8(b.column(1))) @ space)
            out = []
            for i in range(0, len(v), 512):
                cos = v[i : i + 512] @ latent.T
                w = votes(cos, k)
                out.append((w @ (weight * label)) / (w @ weight))
            score = np.clip(np.concatenate(out).astype(np.float64), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    out = base.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), "score", "predicted")
