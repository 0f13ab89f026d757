"""Language identification with a byte convolutional network, trained in numpy.

Bytes are embedded, passed through filters of several widths, each filter's largest response over a
fixed-length window is kept, and a softmax over languages follows. A text's windows cover all of it;
their probabilities are averaged by the bytes they hold. In use, embedding and filters are multiplied
out to one table per filter offset, so that a response is a sum of table rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .common import documents, fold

OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


class ByteCnn:
    def __init__(self, classes: int, width: int = 128, filters: int = 16, sizes=(2, 3, 4), dims: int = 8, seed: int = 0):
        r = np.random.default_rng(seed)
        self.width, self.sizes = width, sizes
        self.p = {"E": r.normal(0, 0.5, (256, dims)), "V": np.zeros((filters * len(sizes), classes)), "c": np.zeros(classes)}
        for w in sizes:
            self.p[f"W{w}"] = r.normal(0, (w * dims) ** -0.5, (w * dims, filters))
            self.p[f"b{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for windows x and classes y."""
        p, n = self.p, len(x)
        e = p["E"][x]
        pooled, where = [], []
        for w in self.sizes:
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, x.shape[1] - w + 1, -1)
            r = view @ p[f"W{w}"]
            at = r.argmax(1)
            pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0] + p[f"b{w}"])
            where.append(at)
        z = np.concatenate(pooled, 1)
        act = np.maximum(z, 0)
        q = softmax(act @ p["V"] + p["c"])
        loss = -np.log(q[np.arange(n), y] + 1e-9).mean()
        d = q.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"V": act.T @ d, "c": d.sum(0), "E": np.zeros_like(p["E"])}
        dz = (d @ p["V"].T) * (z > 0)
        f = dz.shape[1] // len(self.sizes)
        for k, w in enumerate(self.sizes):
            dw, at = dz[:, k * f : (k + 1) * f], where[k]
            pos = at[:, :, None] + np.arange(w)
            bytes_ = x[np.arange(n)[:, None, None], pos]
            patch = p["E"][bytes_].reshape(n, f, -1)
            g[f"W{w}"] = np.einsum("nf,nfd->df", dw, patch)
            g[f"b{w}"] = dw.sum(0)
            back = (dw[:, :, None] * p[f"W{w}"].T[None]).reshape(n, f, w, -1)
            np.add.at(g["E"], bytes_, back)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(order), batch):
                t += 1
                _, g = self.step(x[order[i : i + batch]], y[order[i : i + batch]])
                for k, v in g.items():
                    a, b = m[k]
                    a += 0.1 * (v - a)
                    b += 0.001 * (v * v - b)
                    self.p[k] -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> dict:
        """The trained network as arrays for use: a table of responses for each filter offset."""
        dims = self.p["E"].shape[1]
        t = {w: [np.ascontiguousarray(self.p["E"] @ self.p[f"W{w}"][j * dims : (j + 1) * dims]) for j in range(w)] for w in self.sizes}
        return {"t": t, "b": {w: self.p[f"b{w}"] for w in self.sizes}, "V": self.p["V"], "c": self.p["c"], "width": self.width}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict(net: dict, x: np.ndarray, block: int = 256) -> np.ndarray:
    """Class probabilities of windows (rows of bytes)."""
    out = []
    for i in range(0, len(x), block):
        w_x, pooled = x[i : i + block], []
        for w, tables in net["t"].items():
            n = w_x.shape[1] - w + 1
            r = tables[0][w_x[:, :n]]
            for j in range(1, w):
                r += tables[j][w_x[:, j : j + n]]
            pooled.append(r.max(1) + net["b"][w])
        out.append(softmax(np.maximum(np.concatenate(pooled, 1), 0) @ net["V"] + net["c"]))
    return np.concatenate(out) if out else np.zeros((0, len(net["c"])), np.float32)


def cut_windows(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, windows per document, bytes held by each): whole texts in steps of `width`, the last one padded with 0."""
    size = np.diff(offs)
    per = -(-size // width)
    start = np.repeat(offs[:-1], per) + T.ragged(per) * width
    held = np.minimum(np.repeat(offs[1:], per) - start, width)
    x = np.zeros((len(start), width), np.uint8)
    mask = np.arange(width) < held[:, None]
    x[mask] = buf  # windows tile the texts in order
    return x, per, held


def sampled(docs: DataFrame, folds: int, held_fold: int, per_class: int, width: int = 128, windows_a_text: int = 8) -> list:
    """(lang, windows) of at most per_class training rows of each language, those of the smallest hash of doc_id and text; windows_a_text windows of each, spread over all of it."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_fold))
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * per_class / n + 1e-9))) for k, n in sorted(counts.items())])
    draw = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("draw")

    def cut(batches):
        for b in T.slices(batches, "text", 1 << 20):
            buf, offs = T.utf8(b.column(1))
            rows = []
            for i in range(b.num_rows):
                x, _, held = cut_windows(buf[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]), width)
                x = x[held >= min(16, held.max(initial=0))]
                rows.append(x[np.unique(np.linspace(0, len(x) - 1, min(len(x), windows_a_text)).astype(int))].tobytes() if len(x) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2), b.column(3)], names=["lang", "x", "draw", "doc_id"])

    rows = train.select("lang", "text", draw, "doc_id").where(F.col("draw") < share).mapInArrow(cut, "lang string, x binary, draw double, doc_id long").distinct().collect()  # rows that repeat are one
    out, used = [], {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["doc_id"] is None, r["doc_id"] or 0, bytes(r["x"]))):
        used[r["lang"]] = used.get(r["lang"], 0) + 1
        if used[r["lang"]] <= per_class:
            out.append((r["lang"], np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, width)))
    return out


def train(rows: list, width: int = 128, epochs: int = 4) -> tuple[list[str], dict | None]:
    langs = sorted({k for k, _ in rows})
    if not langs:
        return [], None
    net = ByteCnn(len(langs), width)
    x = np.concatenate([x for _, x in rows])
    y = np.concatenate([np.full(len(x), langs.index(k)) for k, x in rows])
    # short windows too: the ends of texts are cut off like this
    short = x[::2].copy()
    short[::2, width // 4 :] = 0
    short[1::2, width // 8 :] = 0
    if len(x):
        net.fit(np.concatenate([x, short]), np.concatenate([y, y[::2]]), epochs)
    return langs, net.tables()


def language_id(docs: DataFrame, folds: int = 4, held_fold: int = 2, per_class: int = 400, width: int = 128, windows_a_text: int = 8) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of `docs`.

    The network learns from at most `per_class` documents of each language, and `windows_a_text` windows
    spread over each of their texts, outside the held-out fold; it is applied to whole texts of any length.
    Between languages of equal score the first by name is taken. Null texts and texts
    without a letter are `und` with score 0, and so is all if there is nothing to learn from. Rows of null
    lang are predicted but not learnt from. Repeated rows are predicted each; an empty table gives no rows.
    """
    langs, net = train(sampled(docs, folds, held_fold, per_class, width, windows_a_text), width)

    def run(batches):
        names = np.array([*langs, "und"])
        for b in T.slices(batches, limit=1 << 20):
            buf, offs = T.utf8(b.column(1))
            letters = T.by_doc(LETTER[buf], np.diff(offs)) > 0
            for i in np.flatnonzero(~letters):
                letters[i] = any(c.isalpha() for c in bytes(buf[offs[i] : offs[i + 1]]).decode())
            best, score = np.full(len(letters), len(langs)), np.zeros(len(letters))
            if net is not None:
                x, per, held = cut_windows(buf, offs, width)
                p = predict(net, x) * held[:, None]
                c = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0, dtype=np.float64)])
                e = np.cumsum(per)
                q = (c[e] - c[e - per]) / np.maximum(np.diff(offs), 1)[:, None]
                best = np.where(letters, q.argmax(1), len(langs))
                score = np.where(letters, np.clip(q.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best]), pa.array(score)], schema=OUT)

    out = documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), "lang_pred", "score")
