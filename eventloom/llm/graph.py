"""Connected components of a link table, for node counts of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import join_hot, stored

#: Links that one task contracts at most; the number of tasks follows.
LINKS_A_TASK = 250_000
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) of the links given, without the roots themselves."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lo = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], lo)
        np.minimum.at(new, label[y], lo)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def contract(batches):
    """Links of a partition, replaced batch by batch by a star around the smallest node of each tree: as connected, and at most one row a node."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        a, b = forest(a, b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; `edges` has long columns a and b.

    Alternates star operations on a table in the shared folder until nothing changes. Each round
    joins on a node's current smallest neighbour, found by a combining aggregate; the few nodes of
    many neighbours are broadcast, so that none has its neighbours gathered in one place. Links that
    fit one task's bound need no rounds. An empty table gives an empty result.
    """
    now = stored(edges.select("a", "b").mapInArrow(contract, "a long, b long"), "links")
    total = now.count()
    if total <= LINKS_A_TASK:  # one contraction is the answer
        return now.coalesce(1).mapInArrow(contract, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # each neighbour, and the node itself, is linked to the node's smallest
        linked = join_hot(both, least, "a", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = linked.unionByName(least.select("a", F.col("m").alias("b")))
        new = stored(linked.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(-(-total // LINKS_A_TASK)).mapInArrow(contract, "a long, b long").distinct(), "links")
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now, total = new, state["n"]
        if before == state:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
