"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed trigram model over words. The states of the automaton are the n-grams seen in
training that can be a history: the empty one, words (and the start of a text), and word pairs. A state
has an arc for every word that followed it, weighted log10 P(w|state), to the state of the longest seen
suffix, and a failure arc to the state of its history less the first word, weighted log10 of the mass
left for words that never followed. The empty state has an arc for every word. With c for training counts,

    P(w) = (c(w)+1) / (N+V+1),  P(w|h) = (c(hw) + K2 P(w)) / (c(h)+K2),  P(w|gh) = (c(ghw) + K3 P(w|h)) / (c(gh)+K3)

and the failure weight of a state of count c is K/(c+K). K2 and K3 are fitted to the training counts alone:
the mass that all histories leave to new words equals that of the n-grams seen once (Good-Turing).

The automaton grows with the corpus, so no process holds all of it: a bucket of documents asks for the
counts of its words and pairs, then for those of its trigrams whose pairs stand in other buckets too (the
counts of others are its own), and builds the states and arcs that its texts can reach. Texts are cut into
stretches; all stretches of a bucket are traversed together, from left to right, a token at a time, each
carrying its state. A stretch inside a text first reads the two tokens before it, which fix its state.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X, textops as T

END, START = np.uint64(0x9D5B_17F3_0C21_A6E1), np.uint64(0x3E8C_55D2_914B_7F07)
BITS = {1: 64, 2: 48, 3: 48}
#: Counts are summed up in bins, by powers of two, to fit K2 and K3.
BINS = 48
STRETCH = 256
OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
ANSWER = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()), ("sums", pa.binary())])
ANSWER_DDL = "bucket int, n int, shard int, counts binary, sums binary"


def held(ids: pa.Array, folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids.to_pylist()], bool)


def tokens(buf, offs) -> tuple[np.ndarray, np.ndarray]:
    """(unigram keys, tokens per document) of lower-cased words, each text closed by an end."""
    words = T.Words(buf, offs, lower=True)
    per = words.per_doc + 1
    uni = np.full(int(per.sum()), END, np.uint64)
    keep = np.ones(len(uni), bool)
    keep[np.cumsum(per) - 1] = False
    uni[keep] = words.hashes(11)
    return uni, per


def summed(counts: np.ndarray) -> np.ndarray:
    """Bins x (number, sum) of positive counts, then the number of ones."""
    c = counts[counts > 0]
    top = np.minimum(np.frexp(c.astype(np.float64))[1] - 1, BINS - 1)
    out = np.zeros(2 * BINS + 1, np.int64)
    out[:BINS] = np.bincount(top, minlength=BINS)
    np.add.at(out, BINS + top, c)
    out[-1] = (c == 1).sum()
    return out


def prior(histories: np.ndarray, ones: int) -> float:
    """K such that the mass left by histories, sum of c K/(c+K), is that of the n-grams seen once.

    Histories come as `summed`; those of one bin count with their mean. K lies between 0.01 and 10^6.
    """
    n, total = histories[:BINS], histories[BINS : 2 * BINS]
    has = n > 0
    mean, total = total[has] / n[has], total[has]
    lo, hi = 0.01, 1e6
    for _ in range(60):
        k = (lo * hi) ** 0.5
        lo, hi = (k, hi) if (total * k / (mean + k)).sum() < ones else (lo, k)
    return (lo * hi) ** 0.5


class Grams:
    """A bucket's tokens, and its distinct words, pairs and triples with their counts in training texts.

    Ids are places among the distinct keys. `of[n]` gives each token the id of the n-gram that ends there;
    triples are missing (-1) at a text's first token.
    """

    def __init__(self, table: pa.Table, folds: int, fold: int):
        uni, per, ids = [], [], []
        for b in T.slices(table.combine_chunks().to_batches()):
            u, p = tokens(*T.utf8(b.column(b.schema.get_field_index("text"))))
            uni.append(u)
            per.append(p)
            ids.append(b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()))
        self.ids = pa.concat_arrays(ids)
        uni, self.per = np.concatenate(uni), np.concatenate(per).astype(np.int64)
        self.first = np.cumsum(self.per) - self.per
        self.held = held(self.ids, folds, fold)
        self.trained = np.repeat(~self.held, self.per)
        before = np.empty_like(uni)
        before[1:] = uni[:-1]
        before[self.first] = START
        bi = T.mix(before, uni)
        tri = np.empty_like(uni)
        tri[1:] = T.mix(bi[:-1], uni[1:])
        inner = np.ones(len(uni), bool)
        inner[self.first] = False
        self.inner = inner
        self.keys, self.of, self.local = {}, {}, {}
        for n, k, on in ((1, uni, None), (2, bi, None), (3, tri, inner)):
            k = k if on is None else k[on]
            self._count(n, k >> np.uint64(64 - BITS[n]), on)

    def _count(self, n: int, k: np.ndarray, on: np.ndarray | None) -> None:
        order = np.argsort(k)
        s = k[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        place = np.empty(len(s), np.int32)
        place[order] = np.cumsum(new) - 1
        self.keys[n] = s[new]
        self.of[n] = place
        trained = self.trained
        if on is not None:
            self.of[n] = np.full(len(on), -1, np.int32)
            self.of[n][on] = place
            trained = trained[on]
        self.local[n] = np.bincount(place[trained], minlength=len(self.keys[n])).astype(np.int64)

    def asked(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Triples whose both pairs stand elsewhere, so that the triple may too; the ids of each triple's pairs."""
        end = np.flatnonzero(self.of[3] >= 0)
        parts = np.empty((len(self.keys[3]), 2), np.int64)
        parts[self.of[3][end], 0] = self.of[2][end - 1]
        parts[self.of[3][end], 1] = self.of[2][end]
        return elsewhere[parts[:, 0]] & elsewhere[parts[:, 1]], parts


class Automaton:
    """States and arcs that a bucket's texts can reach.

    State 0 is the empty history, 1 the start of a text, then words and pairs that were seen in training.
    `arcs` are sorted keys state x words + word; an arc has a weight and the state that it leads to. The
    empty state's arcs, one for each word, stand apart in `word_weight` and `word_state`.
    """

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], parts: np.ndarray, total: int, distinct: int, k2: float, k3: float):
        of, n_words = grams.of, len(grams.keys[1])
        c1, c2, c3 = (counts[n].astype(np.float64) for n in (1, 2, 3))
        p1 = (c1 + 1.0) / (total + distinct + 1.0)
        self.words = n_words
        state1 = np.zeros(n_words, np.int64)
        seen1 = np.flatnonzero(c1 > 0)
        state1[seen1] = 2 + np.arange(len(seen1))
        seen2 = np.flatnonzero(c2 > 0)
        state2 = np.zeros(len(c2), np.int64)
        state2[seen2] = 2 + len(seen1) + np.arange(len(seen2))
        # the words of each pair; a pair of the start has none before
        old, new = np.full(len(c2), -1, np.int64), np.empty(len(c2), np.int64)
        new[of[2]] = of[1]
        at = np.flatnonzero(grams.inner)
        old[of[2][at]] = of[1][at - 1]
        end = int(np.searchsorted(grams.keys[1], END))
        texts = c1[end]  # texts start as often as they end
        h_count = np.where(old >= 0, c1[old], texts)
        h_state = np.where(old >= 0, state1[old], 1)
        p2 = (c2 + k2 * p1[new]) / (h_count + k2)
        third = np.flatnonzero(c3 > 0)
        gh, hw = parts[third, 0], parts[third, 1]
        w = new[hw]
        p3 = (c3[third] + k3 * p2[hw]) / (c2[gh] + k3)
        n_states = 2 + len(seen1) + len(seen2)
        self.fail, self.fail_weight = np.zeros(n_states, np.int64), np.zeros(n_states)
        self.fail_weight[1] = np.log10(k2 / (texts + k2))
        self.fail_weight[state1[seen1]] = np.log10(k2 / (c1[seen1] + k2))
        self.fail[state2[seen2]] = state1[new[seen2]]
        self.fail_weight[state2[seen2]] = np.log10(k3 / (c2[seen2] + k3))
        arcs = np.concatenate([h_state[seen2] * n_words + new[seen2], state2[gh] * n_words + w])
        weight = np.log10(np.concatenate([p2[seen2], p3]))
        to = np.concatenate([state2[seen2], state2[hw]])
        order = np.argsort(arcs)
        self.arcs, self.weight, self.to = arcs[order], weight[order], to[order]
        self.word_weight, self.word_state = np.log10(p1), state1

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, next states) of many walkers that each read a word: along an arc, else over failure arcs to one."""
        weight, out = np.zeros(len(state)), np.empty(len(state), np.int64)
        live, s = np.arange(len(state)), state
        while len(live):
            asked = s * self.words + word[live]
            at = np.searchsorted(self.arcs, asked)
            found = self.arcs[np.minimum(at, len(self.arcs) - 1)] == asked if len(self.arcs) else np.zeros(len(s), bool)
            found &= s > 0
            hit = live[found]
            weight[hit] += self.weight[at[found]]
            out[hit] = self.to[at[found]]
            ground = s == 0
            low = live[ground]
            weight[low] += self.word_weight[word[low]]
            out[low] = self.word_state[word[low]]
            on = ~(found | ground)
            live, s = live[on], s[on]
            weight[live] += self.fail_weight[s]
            s = self.fail[s]
        return weight, out

    def traverse(self, word: np.ndarray, per: np.ndarray) -> np.ndarray:
        """The weight of each token. Stretches of texts are read in step, each carrying its state."""
        n = -(-per // STRETCH)
        doc = np.repeat(np.arange(len(per)), n)
        start = T.ragged(n) * STRETCH
        size = np.minimum(STRETCH, per[doc] - start)
        at = (np.cumsum(per) - per)[doc] + start
        state = np.where(start == 0, 1, 0)
        later = np.flatnonzero(start > 0)
        for back in (2, 1):  # two tokens of history fix the state
            _, state[later] = self.read(state[later], word[at[later] - back])
        order = np.argsort(-size, kind="stable")
        at, size, state = at[order], size[order], state[order]
        out = np.empty(len(word))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t))
            here = at[:live] + t
            out[here], state[:live] = self.read(state[:live], word[here])
        return out


def _told(told: pa.Table) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Counts for each n in the order of the bucket's keys, which pairs stand elsewhere too, and the corpus' sums for n = 1, 2, 3."""
    rows = sorted(zip(*(told.column(x).to_pylist() for x in ("n", "shard", "counts", "sums"))), key=lambda r: r[:2])
    counts = {n: np.concatenate([np.zeros(0, np.int64), *(X.unpack_counts(c) for m, _, c, _ in rows if m == n)]) for n in (1, 2, 3)}
    sums = [np.frombuffer(s, np.int64).reshape(4, -1) for m, _, _, s in rows if m == 0]
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=int.from_bytes(b[:8], "little") + 64)[64:] for m, _, _, b in rows if m == 2]
    elsewhere = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
    return counts, elsewhere, sums[0] if sums else np.zeros((4, 2 * BINS + 1), np.int64)


def _totals(answers: DataFrame, n_buckets: int) -> DataFrame:
    """The sums of all shards, added up in two steps, as an answer to every bucket."""

    def add(batches):
        out = np.zeros((4, 2 * BINS + 1), np.int64)
        for b in batches:
            for n, s in zip(b.column(1).to_pylist(), b.column(4).to_pylist()):
                part = np.frombuffer(s, np.int64)
                out += part.reshape(4, -1) if n == 0 else np.where(np.arange(4)[:, None] == n, part, 0)
        yield out

    def partial(batches):
        for out in add(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((-1, 0, -1, b"", out.tobytes()), ANSWER)], schema=ANSWER)

    def spread(batches):
        for out in add(batches):
            for at in range(0, n_buckets, 1000):
                n = min(1000, n_buckets - at)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((range(at, at + n), [0] * n, [-1] * n, [b""] * n, [out.tobytes()] * n), ANSWER)], schema=ANSWER)

    return answers.where("bucket < 0").repartition(16).mapInArrow(partial, ANSWER_DDL).repartition(1).mapInArrow(spread, ANSWER_DDL)


def score(docs: DataFrame, folds: int = 7, fold: int = 2, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of `docs`.

    Documents whose crc32(doc_id as text) leaves `fold` modulo `folds` are held out of training. Null
    and empty texts have one token, the end; texts of any length are read whole. A null doc_id counts as
    the empty text for the fold. Repeated rows count and are scored each. Other columns are not looked at.
    An empty table gives no rows. N-grams are told apart by hashes of 48 bits or more.
    """
    base, size = X.bucketed(docs, bucket_bytes)
    shards, n_buckets = X.shard_count(docs, size), X.bucket_count(docs.sparkSession, size, bucket_bytes)
    block = {"bucket": pa.int32(), "n": pa.int32(), "shard": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "ones": pa.int64()}
    block_ddl = "bucket int, n int, shard int, keys binary, counts binary, ones long"

    def blocks(bucket: int, n: int, keys: np.ndarray, counts: np.ndarray, settled_ones: int = 0) -> list:
        """A block for each shard that has keys; one of them also takes the number of n-grams seen once that need no answer."""
        at = X.cuts(keys, shards, BITS[n])
        own = np.flatnonzero(np.diff(at)).tolist() or [bucket % shards]
        return [(bucket, n, s, X.pack_sorted(keys[at[s] : at[s + 1]]), X.pack_counts(counts[at[s] : at[s + 1]]), settled_ones if s == own[0] else 0) for s in own]

    def table_of(rows: list) -> pa.Table:
        cols = list(zip(*rows)) if rows else [[]] * len(block)
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(block.items(), cols)})

    def ask(table: pa.Table) -> pa.Table:
        g = Grams(table, folds, fold)
        bucket = table.column("bucket")[0].as_py()
        return table_of([r for n in (1, 2) for r in blocks(bucket, n, g.keys[n], g.local[n])])

    def answer(batches):
        for shard, got in X.by_shard(batches):
            for n in sorted({b[1] for b in got}):
                mine = [b for b in got if b[1] == n]
                every, at = X.merge([X.unpack_sorted(b[2]) for b in mine])
                total = np.zeros(len(every), np.int64)
                for i, b in zip(at, mine):
                    total[i] += X.unpack_counts(b[3])
                seen = np.zeros(len(every), np.int32)
                for i in at:
                    seen[i] += 1
                several = lambda i: len(i).to_bytes(8, "little") + np.packbits(seen[i] > 1).tobytes() if n == 2 else b""  # noqa: E731, B023
                sums = summed(total)
                sums[-1] += sum(b[4] for b in mine)
                for bucket, counts, own in [*((b[0], X.pack_counts(total[i]), several(i)) for i, b in zip(at, mine)), (-1, b"", sums.tobytes())]:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((bucket, n, shard, counts, own), ANSWER)], schema=ANSWER)

    first = base.groupBy("bucket").applyInArrow(ask, block_ddl).repartitionById(shards, "shard").mapInArrow(answer, ANSWER_DDL)

    def ask_triples(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of([])
        g = Grams(table, folds, fold)
        use, _ = g.asked(_told(told)[1])
        return table_of(blocks(table.column("bucket")[0].as_py(), 3, g.keys[3][use], g.local[3][use], int((g.local[3][~use] == 1).sum())))

    second = base.groupBy("bucket").cogroup(first.where("bucket >= 0").groupBy("bucket")).applyInArrow(ask_triples, block_ddl).repartitionById(shards, "shard").mapInArrow(answer, ANSWER_DDL)

    def walk(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in OUT}, schema=OUT)
        g = Grams(table, folds, fold)
        counts, elsewhere, sums = _told(told)
        use, parts = g.asked(elsewhere)
        all3 = g.local[3].copy()
        all3[use] = counts[3]
        counts[3] = all3
        assert all(len(counts[n]) == len(g.keys[n]) for n in (1, 2, 3)), "answers do not fit the bucket"
        n_tokens, n_words = int(sums[1][BINS : 2 * BINS].sum()), int(sums[1][:BINS].sum())
        model = Automaton(g, counts, parts, n_tokens, n_words, prior(sums[1], int(sums[2][-1])), prior(sums[2], int(sums[3][-1])))
        taken = model.traverse(g.of[1].astype(np.int64), g.per)
        add = lambda x: np.add.reduceat(x, g.first)
        known = (counts[1] > 0)[g.of[1]]
        cols = [g.ids, pa.array(g.held), pa.array(g.per), pa.array(T.by_doc(known, g.per)), pa.array(np.full(len(g.per), n_tokens)), pa.array(add(model.word_weight[g.of[1]])), pa.array(add(taken))]
        return pa.table(cols, schema=OUT)

    both = first.unionByName(second)
    answers = both.where("bucket >= 0").unionByName(_totals(both, n_buckets))
    return base.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(walk, OUT_DDL)
