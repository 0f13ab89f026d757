"""Packing token sequences into windows by best-fit decreasing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T, wordbpe
from .common import documents, partitions, stored

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
#: Pieces packed together in one task: enough for tight windows, few enough for any worker's memory.
PIECES_A_TASK = 20_000
#: Shards, each packed for itself, that share a task where there are many; pieces that carry their ids have one a task.
SHARDS_A_TASK = 32


class Windows:
    """Open windows by remaining capacity: a segment tree of counts over the capacities, with a stack of windows at each leaf."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used: list[int] = []

    def _add(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, size: int) -> int:
        """The smallest remaining capacity of at least `size` that an open window has; -1 if none has."""
        count, i = self.count, self.leaves + size
        if count[i]:
            return size
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def put(self, size: int) -> tuple[int, int]:
        """(window, offset in it) for a piece."""
        room = self.tightest(size)
        if room < 0:
            w, room = len(self.used), self.capacity
            self.used.append(0)
        else:
            w = self.held[room].pop()
            self._add(room, -1)
        offset = self.used[w]
        self.used[w] += size
        if room - size:
            self.held[room - size].append(w)
            self._add(room - size, 1)
        return w, offset


def pieces(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Documents' token ids, closed with end_id, cut into full windows and one rest."""

    def run(batches):
        model = wordbpe.load(vocabulary)
        for b in T.slices(batches):
            ids, per = model.ids(*T.utf8(b.column(1)))
            total = per + 1
            out = np.full(int(total.sum()), end_id, "<u4")
            keep = np.ones(len(out), bool)
            keep[np.cumsum(total) - 1] = False
            out[keep] = ids
            n = -(-total // window)
            doc = np.repeat(np.arange(len(per)), n)
            start = T.ragged(n) * window
            length = np.minimum(window, total[doc] - start)
            at = (np.cumsum(total) - total)[doc] + start
            view = memoryview(out.view(np.uint8))
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + z)]) for a, z in zip(at.tolist(), length.tolist())), np.int64, len(at))
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(out)).astype(np.int32)), pa.array(out.view(np.int32))) if with_ids else pa.nulls(len(at), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), *(pa.array(x) for x in (start, length, crc, total[doc])), lists], schema=PIECE)

    return documents(docs).mapInArrow(run, PIECE_DDL)


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Each piece of each row of `docs` with its sequence_id and its offset there.

    A document is its token ids and end_id; null and empty texts are end_id alone. Overlong documents
    are first cut into full windows, which are sequences of their own; all other pieces are packed by
    best-fit decreasing within shards of about PIECES_A_TASK pieces dealt by hash, so a task's memory
    does not grow with the input. Ties go by doc_id and start: the result does not depend on the order
    of rows. Rows that repeat a doc_id are packed each. An empty table gives no rows.
    """
    table = stored(pieces(docs, vocabulary, window, end_id, with_ids), "pieces")
    shards = max(1, -(-table.count() // PIECES_A_TASK))
    dealt = table.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(shards)).cast("int"))
    schema = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        cols = {c: t.column(c).to_numpy() for c in ("start", "length", "ids_crc32", "shard")}
        ids = np.asarray(t.column("doc_id").fill_null(-(2**63)).to_numpy(), np.int64)
        order = np.lexsort((cols["ids_crc32"], cols["start"], ids, -cols["length"], cols["shard"]))
        shard, length = cols["shard"][order], cols["length"][order]
        seq, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        for a, z in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(order)]]))):
            windows = Windows(window)
            got = [windows.put(s) for s in length[a:z].tolist()]
            seq[a:z] = [w for w, _ in got]
            seq[a:z] += int(shard[a]) << 32
            offset[a:z] = [o for _, o in got]
        t = t.drop_columns(["shard"]).take(pa.array(order)).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
        yield from t.cast(schema).to_batches(max_chunksize=10_000)

    tasks = shards if with_ids or shards <= SHARDS_A_TASK * partitions(docs.sparkSession) else -(-shards // SHARDS_A_TASK)
    return dealt.repartitionById(tasks, F.col("shard") % tasks).mapInArrow(run, PIECE_DDL + ", sequence_id long, offset long")
