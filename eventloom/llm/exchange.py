"""Asking the whole corpus about hashed keys, in blocks.

Documents are dealt into buckets of bounded bytes. A bucket sends each shard one block: its distinct
keys that fall there, sorted and packed, with what it knows of each. A shard merges the blocks of
all buckets and sends each bucket one block of answers in the same order. So a frequent key costs
one entry a bucket however often it occurs, rows between tasks number buckets x shards, and no task
holds more than a bucket or a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as T
from .common import documents, partitions

#: Text whose keys one shard holds; bounds a shard's memory at any size of the corpus.
SHARD_BYTES = 64 << 20


def bucketed(docs: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """(doc_id, text, bucket), and the number of buckets. Buckets hold about bucket_bytes of text, and a document at least."""
    base = documents(docs)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = bucket_count(docs.sparkSession, size, bucket_bytes)
    return base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), size


def bucket_count(spark: SparkSession, size: int, bucket_bytes: int) -> int:
    """Buckets of about bucket_bytes; in small tables smaller ones, a megabyte at least, so that all tasks have some."""
    return max(1, -(-size // bucket_bytes), min(partitions(spark), -(-size // (1 << 20))))


def shard_count(df: DataFrame, size: int) -> int:
    """A shard for each SHARD_BYTES of text, so that none grows with the corpus, and one a task at least."""
    return max(partitions(df.sparkSession), -(-size // SHARD_BYTES))


def by_shard(batches):
    """(shard, its blocks) of each shard that a task holds; repartitionById gives a task one."""
    got: dict[int, list] = {}
    for b in batches:
        at = b.schema.get_field_index("shard")
        for shard, *block in zip(b.column(at).to_pylist(), *(c.to_pylist() for i, c in enumerate(b.columns) if i != at)):
            got.setdefault(shard, []).append(block)
    for shard in sorted(got):
        yield shard, got.pop(shard)


def flags(told: pa.Table, kind: int) -> np.ndarray:
    """The answers of one kind to a bucket, a bit each, in the order of the bucket's keys."""
    rows = sorted((s, c, x) for k, s, c, x in zip(*(told.column(f).to_pylist() for f in ("kind", "shard", "n", "data"))) if k == kind)
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=c) for _, c, x in rows]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def shard_of(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Shards are ranges of the key space, so sorted keys are sorted by shard too."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of the fewest bytes that hold all of them."""
    if not len(keys):
        return b""
    d = keys.copy()
    d[1:] -= keys[:-1]
    top = int(d[1:].max()) if len(d) > 1 else 0
    width = max(1, -(-top.bit_length() // 8))
    return int(keys[0]).to_bytes(8, "little") + bytes([width]) + d[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[8]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    d = np.zeros((len(body) + 1, 8), np.uint8)
    d[1:, :width] = body
    d = d.view(np.uint64).ravel()
    d[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(d, dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """Counts, small ones in a byte."""
    big = np.flatnonzero(c >= 255)
    return len(big).to_bytes(8, "little") + big.astype(np.uint32).tobytes() + c[big].astype(np.uint64).tobytes() + np.minimum(c, 255).astype(np.uint8).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    big = np.frombuffer(data, np.uint32, n, 8)
    c = np.frombuffer(data, np.uint8, offset=8 + 12 * n).astype(np.int64)
    c[big] = np.frombuffer(data, np.uint64, n, 8 + 4 * n)
    return c


def cuts(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard's part of sorted keys begins, and the end."""
    return np.searchsorted(shard_of(keys, shards, bits), np.arange(shards + 1))


def merge(blocks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys of sorted blocks, and where each block's keys are among them."""
    every = T.distinct(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)
    return every, [np.searchsorted(every, b) for b in blocks]
