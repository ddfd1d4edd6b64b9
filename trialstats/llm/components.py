"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialstats.llm.store import stored

# edges that a task contracts at a time
EDGES = 1 << 18


def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges, and the least node that they connect it to."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): every node of a task's edges with the least node they connect it to; contracted whenever EDGES more are there."""
    a, b, new = [], [], 0
    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        new += len(batch)
        if new >= EDGES:
            nodes, least = least_connected(np.concatenate(a), np.concatenate(b))
            a, b, new = [nodes], [least], 0
    if a:
        yield pa.RecordBatch.from_arrays([*map(pa.array, least_connected(np.concatenate(a), np.concatenate(b)))], ["a", "b"])


def _toward_least(edges: DataFrame, large: bool) -> DataFrame:
    """One star step (Kiveris et al. 2014): neighbours above (large) or below (small) a node move to its least neighbour."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that the join has an exchange of its own on both sides and a hub's rows can be split
    least = stored(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    moved = near.where("b > a" if large else "b < a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Does every node point to one other that points nowhere?  Then no step changes anything."""
    repeated = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    onward = edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return repeated.isEmpty() and onward.isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the least node it is connected to.

    Tasks of about EDGES edges each replace them by stars.  If there are several,
    large-star and small-star steps alternate until only stars are left.  Self
    loops and repeated edges are allowed, nulls are not connected."""
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    every = stored(known.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), "edges")
    tasks = -(-every.count() // EDGES)
    every = stored(every.coalesce(max(tasks, 1)).mapInArrow(_contracted, "a long, b long"), "edges")
    if tasks <= 1:
        return every.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = stored(every.where("a <> b").distinct(), "edges")
    while not _are_stars(at):
        at = stored(_toward_least(stored(_toward_least(at, True), "edges"), False), "edges")
    # stars point down, as the first edges do, so the node that points nowhere is the least
    labels = at.select(F.col("a").alias("node"), F.col("b").alias("component"))
    nodes = every.select(F.col("a").alias("node")).distinct()
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
