"""Connected components: parts of the graph contract to stars inside tasks, then large-star and small-star rounds join them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbase.llm.common import cut, small_enough_to_broadcast

#: Edges that one task contracts at once.
SLAB_ROWS = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it reaches) of every node but the least ones: hooking to the lesser root, then shortening of paths."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), place[: len(u)], place[len(u) :]
    while len(open_ := np.flatnonzero(root[a] != root[b])):
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as stars, a bounded slab of them at a time."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        u, v = stars(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for part in parts:
        held.append((part["u"].to_numpy(), part["v"].to_numpy()))
        size += part.num_rows
        if size >= SLAB_ROWS:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _least(edges: DataFrame, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v) and the least neighbour of u, itself included, as m. A star's centre needs no list of its leaves."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
    return edges.join(joined(least), F.col("u") == F.col("_u")).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an edge, the least node it can reach. Nodes are 64-bit integers.

    Self loops and repeated edges are allowed; edges with a null end are left out; no edge gives no row.
    Edges contract to stars in slabs of ``SLAB_ROWS``; where there is more than one slab, rounds that grow
    with the logarithm of the longest path join them, each written and read again. Minima of a counted,
    small graph are broadcast; those of a larger one join by shuffle.
    """
    links = edges.select(F.least(a, b).cast("long").alias("v"), F.greatest(a, b).cast("long").alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    links = cut(links.select("u", "v").distinct())
    size = links.count()
    tasks = 1 + size // SLAB_ROWS
    stars_ = cut(links.coalesce(tasks).mapInArrow(_contract, "u long, v long"))
    if tasks > 1:
        joined = F.broadcast if small_enough_to_broadcast(2 * size, 24, 32) else lambda df: df
        before = _state(stars_)
        for _ in range(most_rounds):
            both = stars_.unionByName(stars_.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _least(both, joined).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            down = _least(large, joined)
            small = down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.where("u != m").select("u", F.col("m").alias("v")))
            stars_ = cut(small.distinct())
            after = _state(stars_)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    leaves = stars_.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = stars_.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(centres)
