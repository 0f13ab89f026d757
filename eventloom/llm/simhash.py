"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most `max_bits` bits
differ in at most `max_bits` bytes, so they share at least 8 - max_bits (five) positional bytes. Posting
lists of single bytes would have N/256 entries each (pairs would grow with the square of the corpus), so
the index is over sets of positions: a posting list holds the fingerprints that share the bytes of three
positions (or four, or five, as distinct fingerprints grow, so that lists stay short at any size). Every
set of positions has its lists; each list a pair stands in counts for one shared set, pairs are tallied,
and those that share at least five bytes' worth of sets (10 of 56 sets of three, 5 of 70 of four) are
verified by their differing bits.

A list that is long (a group of near copies) is not paired. Of a few sets that five positions cannot
avoid, its lists are dealt on by the rest of their bits: of four parts of those bits, one must be equal. A
pair that shares long lists may fall short in its tally: the minimum falls by the fewer of both sides'
long lists. Exact copies meet once, as one fingerprint.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textops as T
from .common import documents, join_hot, stored, without
from .graph import components

FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LANES = np.uint64(0x0101010101010101)
#: Text bytes handled at once: some 30 bytes of working memory each.
SLICE_BYTES = 1 << 20


def majority(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Bits set in over half of each document's hashes. Byte lanes are summed up to 255 at a time."""
    segs = -(-per // 255)
    first = np.cumsum(per) - per
    at = np.repeat(first, segs) + T.ragged(segs) * 255
    out = np.zeros(len(per), np.uint64)
    has = np.flatnonzero(per)
    if not len(has):
        return out
    seg_first = (np.cumsum(segs) - segs)[has]
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, at).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), seg_first, axis=0)
        for j in range(8):
            out[has] |= (2 * counts[:, j] > per[has]).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of lower-cased word shingles. Null and empty texts have 0."""

    def run(batches):
        for b in T.slices(batches, limit=SLICE_BYTES):
            words = T.Words(*T.utf8(b.column(1)), lower=True)
            h, _, per = words.shingles(width, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(majority(h, per).view(np.int64))], schema=FP)

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def position_sets(size: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions such that any `shared` of the eight contain one, found greedily."""
    need = {frozenset(c) for c in combinations(range(8), shared)}
    every = list(combinations(range(8), size))
    if size == 3 and shared == 5:  # two halves: of five positions, three fall in one half
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    out = []
    while need:
        best = max(every, key=lambda s: sum(set(s) <= n for n in need))
        out.append(best)
        need = {n for n in need if not set(best) <= n}
    return out


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _bits(mask: int) -> list[int]:
    return [b for b in range(64) if (mask >> b) & 1]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def postings(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, k, key): each fingerprint in the lists of all position sets, given as masks."""
    return distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("e")).select("fp", "e.k", "e.key")


def tallied(lists: DataFrame) -> DataFrame:
    """(a, b, tally): how many lists each pair shares."""
    # merged: a planner that takes postings for as small as their fingerprints would broadcast them
    pairs = lists.select("k", "key", F.col("fp").alias("a")).hint("merge").join(lists.select("k", "key", F.col("fp").alias("b")), ["k", "key"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("tally"))


def _verified(pairs: DataFrame, max_bits: int) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")


def _lists(keyed: DataFrame, long_list: int) -> tuple[DataFrame, DataFrame]:
    """Postings of lists of several entries: (short lists, long lists). The size is counted before the join, so a hot key costs a row."""
    count = keyed.groupBy("k", "key").agg(F.count("*").alias("m")).where("m > 1")
    sized = keyed.hint("merge").join(count, ["k", "key"])
    return sized.where(F.col("m") <= long_list).select("k", "key", "fp"), sized.where(F.col("m") > long_list).select("k", "key", "fp")


def links(distinct: DataFrame, max_bits: int = 3, long_list: int = 128, n: int | None = None) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints of column fp at `max_bits` or fewer differing bits.

    Every two linked fingerprints are returned, or are joined by returned links of their own list.
    """
    if max_bits < 0 or max_bits > 4:
        raise ValueError("max_bits must be between 0 and 4")
    shared = 8 - max_bits
    n = distinct.count() if n is None else n
    size = next((s for s in range(min(3, shared), shared + 1) if n <= 256**s // 4), shared)
    least = comb(shared, size)
    sets = list(combinations(range(8), size))
    cover = position_sets(size, shared)
    sets = [*cover, *(s for s in sets if s not in cover)]  # the unavoidable ones come first
    masks = [_mask(s) & ((1 << 64) - 1) for s in sets]
    short, heavy = _lists(postings(distinct, masks), long_list)
    heavy = stored(heavy, "long-lists")
    pairs = tallied(short)
    if heavy.isEmpty():
        return _verified(pairs.where(F.col("tally") >= least), max_bits)
    longs = heavy.groupBy("fp").agg(F.count("*").alias("longs"))
    for c in ("a", "b"):
        pairs = pairs.join(longs.select(F.col("fp").alias(c), F.col("longs").alias(f"long_{c}")), c, "left").na.fill(0, f"long_{c}")
    found = _verified(pairs.where(F.col("tally") + F.least("long_a", "long_b") >= least), max_bits)
    masks, keyed = masks[: len(cover)], heavy.where(F.col("k") < len(cover)).select("fp", "k", "key")
    for _ in range(2):
        # the rest of the bits in four parts: at most three of them hold a differing bit
        deal = []
        next_masks = []
        for k, m in enumerate(masks):
            rest = _bits(~m & ((1 << 64) - 1))
            q = -(-len(rest) // (max_bits + 1))
            for i in range(0, len(rest), q):
                part = sum(1 << b for b in rest[i : i + q])
                deal.append(F.struct(F.lit(k).alias("from"), F.lit(len(next_masks)).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m | part))).alias("key")))
                next_masks.append(m | part)
        keyed = keyed.select("fp", "k", F.explode(F.filter(F.array(*deal), lambda e: e["from"] == F.col("k"))).alias("e")).select("fp", "e.k", "e.key")
        masks = next_masks
        short, keyed = _lists(keyed, long_list)
        keyed = stored(keyed, "long-lists")
        found = found.unionByName(_verified(tallied(short), max_bits))
        if keyed.isEmpty():
            return found
    # lists that agree in all but a few bits: neighbours are looked up by flipping those bits
    return found.unionByName(_flips(keyed, masks, max_bits))


def _flips(keyed: DataFrame, masks: list[int], max_bits: int) -> DataFrame:
    """Links within lists whose open bits are few: each fingerprint looks up those at a flipped distance.

    x and y differ in at most max_bits open bits exactly if some z is ceil(max_bits/2) flips from one and the
    rest from the other. All at the former distance of z are linked to the smallest at the latter: each such
    link is within max_bits, both x and y get one, and a dense group gives a star for each z, not its pairs.
    """
    half, other = -(-max_bits // 2), max_bits // 2
    open_bits = {k: _bits(~m & ((1 << 64) - 1)) for k, m in enumerate(masks)}

    def spread(most: int, name: str) -> DataFrame:
        table = keyed.sparkSession.createDataFrame([(k, _signed(sum(1 << b for b in c))) for k, bits in open_bits.items() for r in range(most + 1) for c in combinations(bits, r)], "k int, flip long")
        return keyed.join(F.broadcast(table), "k").select(F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), F.col("fp").alias(name)).distinct()

    least = spread(other, "b").groupBy("z").agg(F.min("b").alias("b"))
    return spread(half, "a").join(least, "z").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of `docs`.

    component_id is the smallest doc_id reachable over links of at most max_bits differing bits, the
    document's own included. Null and empty texts have fingerprint 0 and are linked like others. Rows
    that repeat a doc_id each give a row; a null doc_id counts for no component_id but is kept (its
    component_id is null if nothing else is reachable). An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, width, seed), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "n")
    return join_hot(fps, named, "fp", fps.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 5, max_bits: int = 3) -> DataFrame:
    """The documents of `docs` that have the smallest doc_id of their group of near copies, all columns kept.

    Of rows with one doc_id the operator keeps all or none. Rows of null doc_id are kept.
    """
    groups = near_duplicates(docs, width, max_bits).where("doc_id <> component_id")
    return without(docs, groups.select("doc_id"))
