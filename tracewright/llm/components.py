"""Connected components in Spark; no links or labels reach the driver.

Edge tables are contracted by alternating stars until at most AT_ONCE edges are left, a fixed bound of 16 MB, which one
task of an executor then joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import forget, written

AT_ONCE = 1_000_000


def join_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and roots (the least node of the component) by hooking and pointer jumping; roots themselves are left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return nodes[root != np.arange(len(nodes))], nodes[root[root != np.arange(len(nodes))]]
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (root[root] != root).any():
            root = root[root]


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    node, root = join_edges(table["u"].to_numpy(), table["v"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """node and root (the least node of its component) of every node with an edge, the root itself left out. edges: u, v, both long."""
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    while state[0] > at_once:
        new = written(_small_star(_large_star(e)), "edges")
        forget(e)
        e, before = new, state
        state = _state(e)
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if state[0]:
        e = written(e.select("u", "v").coalesce(1).mapInArrow(_join_all, "u long, v long"), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
