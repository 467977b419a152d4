"""Connected components of an edge table: contraction inside partitions, then alternating stars.

First every partition replaces its edges by a forest (each node with the least
node that its edges reach), without a shuffle; so a hub, or a group of which a partition
holds many edges, leaves one row a node and partition. A table of up to
ONE_TASK rows is then settled by one task with the same function. A larger one
goes on in rounds of star contraction, where each half-round is an aggregation
with map-side combine and an equi-join, of which AQE can split the side of a
hub. Nothing but two scalars of the edge table
(its size and a fingerprint, to see that it no longer changes) reaches the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import checkpointed

#: Rows of a contracted edge table that one task settles: 16 MB.
ONE_TASK = 1_000_000
#: Edges that a task gathers before it contracts them: 4 MB.
MERGED = 250_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of every node of the edges but the least ones themselves."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(further := root[root], root):
            root = further
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with (a, b) where b < a is the least node that a reaches in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        more: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                more.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                rows += batch.num_rows
            if rows and (batch is None or rows >= max(len(a), MERGED)):
                a, b = forest(np.concatenate([a, *(x for x, _ in more)]), np.concatenate([b, *(y for _, y in more)]))
                more, rows = [], 0
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node's neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node itself, is linked to the least of them. Needs b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Loops, repeated edges and either direction are allowed; edges with a null end are ignored.
    """
    now = edges.select(F.greatest(left, right).cast("long").alias("a"), F.least(left, right).cast("long").alias("b")).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    now, before = checkpointed(_contracted(now.where("a <> b"))), None
    if now.count() <= ONE_TASK:
        now, max_rounds = checkpointed(_contracted(now.coalesce(1))), 0
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, now = mark, checkpointed(_small_star(_large_star(now)))
    else:
        if max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
