"""The study of blocks: their bases on three graphs side by side, kept by block, and clusters of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.space import AXES, BLOCK
from voxloom.operators import ragft, spectral
from voxloom.operators.features import looped_points
from voxloom.operators.graph import KEYS
from voxloom.operators.ragft import VALUES, Columns
from voxloom.operators.voxel import CHANNELS

#: Graphs of the study: 2/d, 2 / (d (1 + difference of luminance)), and 2/d with a self loop of weight 2.
GRAPHS = ("plain", "luma", "loop")
_RECORD = "frame_id int, bx long, b_y long, bz long, graph int, rows array<struct<k: int, freq: double, vector: array<double>, c0: double, c1: double, c2: double>>"


def _records(block: np.ndarray, graph: int, u: np.ndarray, freq: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Records of stacked blocks of n points: keys (B, 4), bases (B, n, n), frequencies (B, n), coefficients (B, n, 3)."""
    count, n = freq.shape
    every = lambda total: pa.array(np.arange(0, total + 1, n), pa.int32())
    vector = pa.ListArray.from_arrays(every(u.size), pa.array(u.ravel()))
    columns = [pa.array(np.tile(np.arange(n), count), pa.int32()), pa.array(freq.ravel()), vector, *(pa.array(c[..., j].ravel()) for j in range(3))]
    rows = pa.ListArray.from_arrays(every(count * n), pa.StructArray.from_arrays(columns, ["k", "freq", "vector", *VALUES]))
    keys = [pa.array(block[:, i], pa.int64() if i else pa.int32()) for i in range(4)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(np.full(count, graph), pa.int32()), rows], [*KEYS, "graph", "rows"])


def block_bases(points: DataFrame, size: int, dealt: bool = False) -> DataFrame:
    """(keys, graph, rows): the study record of a block and graph; rows in order of k, each (k, freq, vector, c0..c2).

    vector is row k of the unweighted basis, its entries in (x, y, z) order of the points. points: with luminance and colours.
    Points are dealt once, by block (not even that where they are dealt already), and a record leaves the task whole, so no entry of a basis is shuffled.
    """
    own = looped_points(points, size, dealt=dealt).select(
        F.col("frame_id").cast("int").alias("frame_id"), *[F.col(b).alias(c) for b, c in zip(BLOCK, ragft._CELL, strict=True)], *[F.col(a).cast("long").alias(a) for a in AXES],
        *[F.col(c).cast("double").alias(v) for c, v in zip(CHANNELS, VALUES, strict=True)], F.when(F.col("looped"), 2.0).otherwise(0.0).alias("loop"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in ragft._pieces(batches):
            yield from make(piece)

    def make(piece: Columns) -> Iterator[pa.RecordBatch]:
        coords = ragft._at(piece)
        order, first, count = spectral.grouped(coords, size)
        v, a, loop = coords[order], np.stack([piece[c] for c in VALUES], 1)[order], piece["loop"][order]
        block = spectral.blocks_of(v, size)
        for n in np.unique(count):
            for at in np.array_split(first[count == n][:, None] + np.arange(n), int((count == n).sum() * n * n // 200_000) + 1):
                near = spectral.neighbour_weights(v[at][..., 1:])
                luma = np.abs(a[at][:, :, None, 0] - a[at][:, None, :, 0]) / 256.0
                for g, (w, loops_of) in enumerate(((near, np.zeros(at.shape)), (near / (1.0 + luma), np.zeros(at.shape)), (near, loop[at]))):
                    # Of several zero frequencies the order of the rows is that of the eigenvalues, as in a plain decomposition.
                    u, f = spectral.basis(w, np.ones(at.shape), loops_of)
                    yield _records(block[at[:, 0]], g, u, f, u @ a[at])

    # Whole blocks are in one task already: the windows of looped_points are by block.
    return own.sortWithinPartitions(*ragft._KEYS).mapInArrow(run, _RECORD)


def first_vectors(records: DataFrame) -> DataFrame:
    """(keys, graph, i, entry, magnitude): the first eigenvector of each block as a signal."""
    return records.select(*KEYS, "graph", F.posexplode(F.col("rows")[0]["vector"]).alias("i", "entry")).withColumn("magnitude", F.abs("entry"))


def point_table(points: DataFrame, records: DataFrame, size: int, graph: int = 0, k: int = 0) -> DataFrame:
    """(keys, x, y, z, value): points of blocks with the entries of one basis vector, to be drawn in its colours."""
    from voxloom.functions.space import block_of

    own = points.select("frame_id", *AXES, *block_of(size)).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*AXES))).alias("p"))
    chosen = records.where(F.col("graph") == graph).select(*KEYS, F.filter("rows", lambda r: r["k"] == k)[0]["vector"].alias("v"))
    both = own.join(chosen, list(KEYS)).select(*KEYS, F.explode(F.arrays_zip("p", "v")).alias("e"))
    return both.select(*KEYS, *[F.col(f"e.p.{a}").alias(a) for a in AXES], F.col("e.v").alias("value"))


def arrow_anchors(points: DataFrame, means: DataFrame, size: int) -> DataFrame:
    """(keys, ax, ay, az, mx, my, mz): of each block with a mean direction, the arrow from the corner that it points away from, as long as the block's points reach, less one."""
    from voxloom.functions.space import block_of

    reach = points.select("frame_id", *AXES, *block_of(size)).groupBy(*KEYS).agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))])
    both = reach.join(means.dropna(subset=["mx"]), list(KEYS))
    return both.select(*KEYS, *[F.when(F.col(f"m{a}") < 0, F.col(f"high_{a}")).otherwise(F.col(f"low_{a}")).alias(f"a{a}") for a in AXES], *[(F.col(f"m{a}") * (F.col(f"high_{a}") - F.col(f"low_{a}") - 1)).alias(f"m{a}") for a in AXES])


def cluster_members(records: DataFrame, clustered: DataFrame) -> DataFrame:
    """records of the blocks that have a cluster, with it."""
    return records.join(clustered.select(*KEYS, "cluster"), list(KEYS))


def write_store(table: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Write a table of blocks, bucketed and sorted by their keys, so that tables of as many buckets join without a shuffle."""
    writer = table.write.mode("overwrite").bucketBy(buckets, *KEYS).sortBy(*KEYS)
    (writer.option("path", path) if path else writer).saveAsTable(name)
