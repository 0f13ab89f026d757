"""Near copies by long SimHashes of word shingles, a byte-position inverted index with count filtering, and exact similarity.

A fingerprint is 128 positional bytes: the SimHash of a text's set of shingles in 1024 bits. Two sets of similarity 0.8
differ in 15 of 100 bits, whatever their sizes, so they agree in a positional byte with probability 0.27 and
in two with 0.07; the radius of 232 bits lies over six deviations beyond. A posting list holds the fingerprints that
agree in a set of positions: two bytes, and some bits of a third as the corpus grows, so that lists stay short.
Pairs of a list that are near enough in size and in 256 bits lead to each other; what they lead to, over all lists, is
a neighbourhood. Pairs of a neighbourhood that share two lists are verified by all their bits, and then by the Jaccard
similarity of their whole sets.

Pairs are never rows. A list gives a forest of its near members, and a neighbourhood, dealt out in blocks of two chunks
each if it is large, a forest of its similar sets, in which pairs that are joined already are not looked at again.

A list of more than `long_list` sets is first tested against one of its members (another for each list); sets outside
the list's largest neighbourhood are then looked at against all of it: in blocks if they are few, else by one and two
more positional bytes first. Documents of equal sets meet once, as one set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .common import documents, join_hot, stored, without
from .graph import EDGE, components, forest
from .simhash import majority

#: Positional bytes of a fingerprint, the longs that hold them, and those of them that postings carry.
POSITIONS, LONGS, CARRIED = 128, 16, 4
#: Differing bits of a candidate pair at most: of all, and of those carried; lists that it must share.
RADIUS, RADIUS_CARRIED, LEAST_SHARED = 232, 62, 2
#: Steps between the positions of a list; the more bits lists agree in, the more of them are used.
STEPS = (37, 11, 53, 29)
#: Fingerprints for which two bytes do, and positions after a long list's own that it is dealt on by.
TWO_BYTES, NEXT = 1 << 18, 8
GISTS = [f"g{i}" for i in range(CARRIED)]
MARK = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("fp", pa.list_(pa.int64()))])
POSTING = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), *((g, pa.int64()) for g in GISTS)])
SET = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
SLICE_BYTES = 1 << 20
#: Sets of a neighbourhood's chunk, up to MOST_CHUNKS chunks; of a larger neighbourhood's; shingles of either. Members of a long list that meet in a block, twice.
CHUNK, MOST_CHUNKS, LARGE_CHUNK, CHUNK_SHINGLES, BLOCK = 256, 16, 2048, 1 << 20, 512
#: Fingerprints that one task posts and counts the lists of.
NODES_A_TASK = 1 << 13
#: Bytes of whole lists or blocks that are worked on at once, and pairs held until they are contracted.
WHOLE_BYTES, HELD_PAIRS = 1 << 22, 1 << 20
_random = np.random.default_rng(17)
XORS, FACTORS = (_random.integers(0, 2**64, LONGS, np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def _sets(h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles by document, their count for each document, a hash of each document's set); 0 for no shingle."""
    doc = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, n = h[new], np.bincount(doc[new], minlength=len(per))
    node = np.zeros(len(per), np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        total = np.add.reduceat(T.mix(h, h), (np.cumsum(n) - n)[has])
        node[has] = T.mix(total, n[has].astype(np.uint64))
    return h, n, node


def long_simhash(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Documents x LONGS: bits set in over half of the hashes of each document's shingles, in 64 ways to hash for each long."""
    out = np.zeros((len(per), LONGS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LONGS):
            x = (h ^ XORS[k]) * FACTORS[k]
            x ^= x >> np.uint64(32)
            x *= FACTORS[k - 1]
            out[:, k] = majority(x ^ (x >> np.uint64(29)), per)
    return out


def list_keys(fps: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints x lists: the number of the list's set of positions, then the 16 bits, and `bits` more, that its members agree in."""
    byte, at, out = np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1).astype(np.int64), np.arange(POSITIONS), []
    for i, step in enumerate(STEPS[: 1 + -(-bits // 4)]):
        first, second, third = (byte[:, (at + j * step) % POSITIONS] for j in range(3))
        out.append((i * POSITIONS + at) << 24 | (third & ((1 << bits) - 1)) << 16 | second << 8 | first)
    return np.concatenate(out, axis=1)


def more_bits(n: int) -> int:
    """Bits of a third byte that the lists of `n` fingerprints agree in."""
    return min(8, max(0, (n - 1) // TWO_BYTES).bit_length())


def postings(nodes: DataFrame, n: int) -> DataFrame:
    """(key, node, size, g0, …): each of `n` fingerprints in the lists of all sets of positions. Lists have some four members, of texts without copies."""
    bits = more_bits(n)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                fps = b.column(2).flatten().to_numpy().reshape(-1, LONGS)
                keys = list_keys(fps, bits)
                each = lambda v: pa.array(np.repeat(v, keys.shape[1]))
                gists = [each(fps[:, i]) for i in range(CARRIED)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), each(b.column(0).to_numpy()), each(b.column(1).to_numpy().astype(np.int32)), *gists], schema=POSTING)

    return nodes.where("size > 0").select("node", "size", "fp").mapInArrow(run, "key long, node long, size int, " + ", ".join(f"{g} long" for g in GISTS))


def _lists(has: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The rows as lists, for documents that have one; others have an empty list."""
    ends = np.concatenate([[0], np.cumsum(has * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.view(np.int64).ravel()))


def _marked(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in T.slices(batches, limit=SLICE_BYTES):
            h, _, per = T.Words(*T.utf8(b.column(1)), lower=True).shingles(width)
            h, n, node = _sets(h, per)
            has = n > 0
            fps = long_simhash(h, n[has]) if has.any() else np.zeros((0, LONGS), np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node.view(np.int64)), pa.array(n), _lists(has, fps)], schema=MARK)

    return documents(docs).mapInArrow(run, "doc_id long, node long, size long, fp array<long>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes of `wanted` (node, least: the smallest doc_id that has the set)."""

    def run(batches):
        for b in T.slices(batches, limit=SLICE_BYTES):
            h, _, per = T.Words(*T.utf8(b.column(1)), lower=True).shingles(width)
            s, n, node = _sets(h, per)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))], schema=SET)

    base = documents(docs)
    few = base.join(wanted.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    return few.mapInArrow(run, "node long, shingles array<long>").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def whole(batches, keys: int):
    """Tables of some WHOLE_BYTES that part no run of rows with equal values in the first `keys` columns; rows come sorted by these."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < WHOLE_BYTES:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.flatnonzero(np.any([(k := t.column(i).to_numpy()) != k[-1] for i in range(keys)], axis=0))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut).to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_in_lists(key: np.ndarray, node: np.ndarray, size: np.ndarray, gists: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the nodes that meet in a list (rows of equal key, which stand together) and whose sizes and carried bits allow the similarity."""
    a = b = np.zeros(0, np.int64)
    held, n, at, step = [], 0, np.arange(len(key)), 0
    while True:
        step += 1
        at = at[: np.searchsorted(at, len(key) - step)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        x, y = at, at + step
        differ = np.zeros(len(x), np.int64)
        for i, g in enumerate(gists):
            differ += np.bitwise_count(g[x] ^ g[y])
            near = differ <= RADIUS_CARRIED
            if i == 0:
                near &= np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
            x, y, differ = x[near], y[near], differ[near]
        held.append((node[x], node[y]))
        n += len(x)
        if n > HELD_PAIRS:
            a, b = forest(*(np.concatenate(c) for c in zip((a, b), *held)))
            held, n = [], 0
    return forest(*(np.concatenate(c) for c in zip((a, b), *held)))


def neighbours(lists: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), at most one a node and task, that connect the near members of each list."""

    def run(batches):
        a = b = np.zeros(0, np.int64)
        for t in whole(batches, 1):
            key, node, size, *gists = (c.to_numpy() for c in t.columns)
            x, y = near_in_lists(key, node, size, [g.view(np.uint64) for g in gists], similarity)
            a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE)

    return lists.select("key", "node", "size", *GISTS).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def joined(fps: np.ndarray, sizes: np.ndarray, flat: np.ndarray, side: np.ndarray, bits: int, similarity: float) -> tuple[list[int], list[int]]:
    """A forest of the similar sets of a block, as row numbers; `flat` has the sets one after the other. If any row is of the other side, only pairs across count."""
    keys, ids, starts = list_keys(fps, bits), np.unique(flat, return_inverse=True)[1], np.cumsum(sizes) - sizes
    label, mark, across, a, b = np.arange(len(fps)), np.zeros(ids.max(initial=0) + 1, bool), side.any(), [], []
    for i in np.flatnonzero(~side):
        js = np.flatnonzero(side & (label != label[i])) if across else i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        js = js[np.minimum(sizes[js], sizes[i]) >= similarity * np.maximum(sizes[js], sizes[i]) - 1e-9]
        js = js[np.bitwise_count(fps[js] ^ fps[i]).sum(1) <= RADIUS]
        js = js[(keys[js] == keys[i]).sum(1) >= LEAST_SHARED]
        if not len(js):
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[ids[T.gather(starts[js], sizes[js])]].astype(np.int64), np.cumsum(sizes[js]) - sizes[js])
        mark[own] = False
        for j in js[both * (1 + similarity) >= similarity * (sizes[i] + sizes[js]) - 1e-9]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(i)
                b.append(j)
    return a, b


def verified(blocks: DataFrame, bits: int, similarity: float) -> DataFrame:
    """Links (a, b), a forest for each block (rows of equal root, low and high), of the sets that have at least this Jaccard similarity."""

    def run(batches):
        for t in whole(batches, 3):
            root, low, high, side, node = (t.column(i).to_numpy() for i in range(5))
            fps = t.column(5).chunk(0).flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
            sets = t.column(6).chunk(0)
            sizes, flat = sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()
            new = np.flatnonzero((root[1:] != root[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            ends, a, b = np.concatenate([[0], np.cumsum(sizes)]), [], []
            for s, e in zip([0, *new], [*new, len(node)]):
                x, y = joined(fps[s:e], sizes[s:e], flat[ends[s] : ends[e]], side[s:e] == 1, bits, similarity)
                a += [s + i for i in x]
                b += [s + j for j in y]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], schema=EDGE)

    rows = blocks.select("root", "low", "high", "side", "node", "fp", "shingles")
    return rows.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(run, "a long, b long")


def in_blocks(members: DataFrame) -> DataFrame:
    """(root, low, high, side, node, fp): each two chunks of a neighbourhood meet in a block, and each chunk's sets in one of its own.

    `members` has node, root, size and fp. Chunks are bounded in sets and in shingles.
    """
    n, whole_sets = F.col("n"), F.ceil(F.col("n") / CHUNK)
    chunks = F.when(whole_sets <= MOST_CHUNKS, whole_sets).otherwise(F.greatest(F.lit(MOST_CHUNKS), F.ceil(n / LARGE_CHUNK)))
    by_root = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    by_root = by_root.select("root", "n", F.greatest(chunks, F.ceil(F.col("total") / CHUNK_SHINGLES)).alias("chunks"))
    dealt = join_hot(members, by_root, "root", members.count()).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "fp")


def links(nodes: DataFrame, docs: DataFrame, width: int, similarity: float, long_list: int = 256) -> DataFrame:
    """Links (a, b) between sets of at least this similarity; what the lists bring together is linked, or joined by links."""
    n = nodes.count()
    lists = postings(nodes.repartition(-(-n // NODES_A_TASK) or 1, "node"), n)
    long = stored(lists.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > long_list), "long-lists")
    heavy = stored(lists.join(long, "key").withColumn("k", F.shiftright("key", 24) % POSITIONS), "long-lists")
    near = stored(neighbours(lists.join(long, "key", "left_anti"), similarity), "near")
    for level in range(3):
        if heavy.isEmpty():
            break
        near = stored(near.unionByName(_star(heavy, similarity)), "near")
        heavy = heavy.drop("root").join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node"))
        group = heavy.groupBy("key", "root").agg(F.count("*").alias("c"), F.first("m").alias("m")).groupBy("key").agg(F.max_by("root", "c").alias("most"), (F.first("m") - F.max("c")).alias("outside")).where("outside > 0")
        heavy = stored(heavy.join(group, "key"), "long-lists")
        few = heavy if level == 2 else heavy.where(F.col("outside") <= long_list)
        near = stored(near.unionByName(neighbours(_outside_by_all(few), similarity)), "near")
        many = heavy.where(F.col("outside") > long_list)
        if level == 2 or many.isEmpty():
            break
        step = F.explode(F.sequence(F.lit(1), F.lit(NEXT))).alias("step")
        dealt = many.select("node", "size", *GISTS, "key", "k", step).withColumn("k", ((F.col("k") + 5 * F.col("step")) % POSITIONS).cast("int"))
        byte = F.expr("shiftrightunsigned(element_at(fp, cast(k div 8 as int) + 1), k % 8 * 8) & 255")
        dealt = dealt.join(nodes.select("node", "fp"), "node").withColumn("byte", byte)
        dealt = dealt.select("node", "size", *GISTS, "k", F.xxhash64("key", "k", "byte").alias("key"))
        dealt = stored(dealt.join(dealt.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"), "posting-lists")
        short, heavy = dealt.where(F.col("m") <= long_list), dealt.where(F.col("m") > long_list)
        near = stored(near.unionByName(neighbours(short, similarity)), "near")
    rooted = components(near)
    rooted = rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
    members = stored(rooted.join(nodes.select("node", "least", "size", "fp"), "node"), "neighbourhoods")
    sets = stored(_shingle_sets(docs, members.select("node", "least"), width), "shingle-sets")
    return stored(verified(in_blocks(members).join(sets, "node"), more_bits(n), similarity), "similar")


def _star(heavy: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of one member of each list with the list's near members; the join tests this, so others are never made."""
    lead = heavy.groupBy("key").agg(F.min_by(F.struct("node", "size", *GISTS), F.xxhash64("node", "key")).alias("l")).select("key", "l.*")
    one = lead.select("key", *[F.col(c).alias(f"x_{c}") for c in ("node", "size", *GISTS)])
    near = F.least("x_size", "size") >= similarity * F.greatest("x_size", "size") - 1e-9
    differ = sum((F.bit_count(F.col(f"x_{g}").bitwiseXOR(F.col(g))) for g in GISTS), F.lit(0))
    return heavy.join(one, "key").where((F.col("x_node") != F.col("node")) & near & (differ <= RADIUS_CARRIED)).select(F.col("x_node").alias("a"), F.col("node").alias("b")).distinct()


def _outside_by_all(heavy: DataFrame) -> DataFrame:
    """Long lists dealt anew, so that each member outside the list's largest neighbourhood meets every member in one block of BLOCK of either."""
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK))
    own, each = (lambda c: F.pmod(F.xxhash64("node"), parts(c))), (lambda c: F.explode(F.sequence(F.lit(0).cast("long"), parts(c) - 1)))
    every = heavy.withColumn("r", own("m")).withColumn("o", each("outside"))
    outside = heavy.where("root <> most").withColumn("o", own("outside")).withColumn("r", each("m"))
    return every.unionByName(outside).withColumn("key", F.xxhash64("key", "r", "o"))


def groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, long_list: int = 256) -> DataFrame:
    """(doc_id, component_id), one row per row of `docs`: the smallest doc_id that the document reaches over similar pairs.

    Null and empty texts have equal (empty) sets. A null doc_id counts for no component_id.
    """
    marked = stored(_marked(docs, width), "shingle-marks")
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.count("*").alias("n")), "shingle-nodes")
    roots = components(links(nodes, docs, width, similarity, long_list))
    rooted = nodes.join(roots, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id", "n")
    return join_hot(marked.select("doc_id", "node"), named, "node", marked.count()).select("doc_id", "component_id")


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents of `docs` that have the smallest doc_id of their group of near copies, all columns kept.

    Of rows with one doc_id the operator keeps all or none. Rows of null doc_id are kept.
    """
    return without(docs, groups(docs, width, similarity).where("doc_id <> component_id").select("doc_id"))
