"""Neighbour graphs inside blocks as edge tables, their weights, degrees and Laplacians."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.space import AXES, BLOCK, block_of

KEYS = ("frame_id", *BLOCK)
#: Edge of the cells of whole blocks that one call labels.
CELL = 32
#: Edge of the tiles whose voxels meet in one row; larger blocks are cut into tiles with a border of one voxel.
TILE = 16
_TILE = ("__tx", "__ty", "__tz")


def _codes(side: int, at: list[str]) -> tuple[str, str]:
    """SQL of the 4-cell of a place in a tile of that side, and of its bit in the cell's mask."""
    cells = (side + 3) // 4
    x, y, z = at
    return f"((({x}) >> 2) * {cells} + (({y}) >> 2)) * {cells} + (({z}) >> 2)", f"((({x}) & 3) << 4) | ((({y}) & 3) << 2) | (({z}) & 3)"


def _tiled(points: DataFrame, size: int, values: tuple[str, ...], dealt: bool = False) -> tuple[DataFrame, int]:
    """(keys, tile, x, y, z, values, own, i, j, k): places in tiles, and the side of a tile.

    Blocks up to TILE are tiles themselves, with a row a point. A point of a larger block goes also,
    not as its own, to the tiles of the block that it borders on.
    """
    own = points.select("frame_id", *AXES, *values, *(BLOCK if dealt else block_of(size)))
    if size <= TILE:
        return own.select("*", *[F.lit(0).cast("long").alias(t) for t in _TILE], F.lit(True).alias("own"), *[(F.col(a) - F.col(b) * size).cast("int").alias(i) for a, b, i in zip(AXES, BLOCK, "ijk", strict=True)]), size
    shifts = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("dx", "dy", "dz"), strict=True)]) for o in product((-1, 0, 1), repeat=3)])
    each = own.select("*", F.explode(shifts).alias("o"))
    bits = TILE.bit_length() - 1
    for a, b, t, d in zip(AXES, BLOCK, _TILE, ("dx", "dy", "dz"), strict=True):
        there = F.col(a) + F.col(f"o.{d}")
        # The tile a voxel further: another one than the point's, for points at its border only.
        each = each.where((F.shiftright(there, size.bit_length() - 1) == F.col(b)) & ((F.col(f"o.{d}") == 0) | (F.shiftright(there, bits) != F.shiftright(F.col(a), bits)))).withColumn(t, F.shiftright(there, bits).cast("long"))
    own_tile = (F.col("o.dx") == 0) & (F.col("o.dy") == 0) & (F.col("o.dz") == 0)
    return each.select("frame_id", *AXES, *values, *BLOCK, *_TILE, own_tile.alias("own"), *[(F.col(a) - F.col(t) * TILE + 1).cast("int").alias(i) for a, t, i in zip(AXES, _TILE, "ijk", strict=True)]), TILE + 2


def neighbour_edges(points: DataFrame, size: int, values: tuple[str, ...] = ("cy",), itself: bool = False, dealt: bool = False) -> DataFrame:
    """(keys, x, y, z, nx, ny, nz, d2, values, n_values): edges in both directions between neighbours of one block.

    Points are dealt once, by block. There each 4 x 4 x 4 cell is a mask of 64 bits: whether a
    neighbour is there is a bit, and its place among the cell's points the number of bits
    below. Rows stay partitioned by the block's key. itself: with an edge of d2 0 from each point to itself.
    dealt: points have their block's key and lie with it already (voxel_view with a size).
    """
    tiled, side = _tiled(points, size, values, dealt)
    cell, bit = _codes(side, ["i", "j", "k"])
    keys, cells = [*KEYS, *_TILE], ((side + 3) // 4) ** 3
    held = (tiled if dealt else tiled.repartition(*KEYS)).select(*keys, F.expr(cell).alias("__cell"), F.struct(F.expr(bit).alias("bit"), "own", *AXES, *values, "i", "j", "k").alias("p"))
    masks = held.groupBy(*keys, "__cell").agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("mask"), F.sort_array(F.collect_list("p")).alias("of"))
    tiles = masks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__cell", F.struct("mask", "of")))).alias("__m"))
    dense = tiles.withColumn("__mask", F.expr(f"transform(sequence(0, {cells - 1}), c -> coalesce(__m[c].mask, 0L))")).withColumn("__of", F.expr(f"transform(sequence(0, {cells - 1}), c -> __m[c].of)"))
    listed = dense.select(*keys, "__mask", "__of", F.expr("flatten(filter(__of, x -> x IS NOT NULL))").alias("__p"))
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("dx", "dy", "dz"), strict=True)]) for o in product((-1, 0, 1), repeat=3) if itself or any(o)])
    # No tile is without points; the outer form keeps Spark from computing the lists twice to test that.
    sent = listed.select(*keys, "__mask", "__of", F.explode_outer("__p").alias("p")).where("p.own").select("*", F.explode(offsets).alias("o"))
    sent = sent.select(*keys, "__mask", "__of", "p", "o", *[(F.col(f"p.{i}") + F.col(f"o.d{a}")).alias(f"__{i}") for i, a in zip("ijk", AXES, strict=True)])
    sent = sent.where(" AND ".join(f"__{i} >= 0 AND __{i} < {side}" for i in "ijk"))
    cell, bit = _codes(side, ["__i", "__j", "__k"])
    hit = sent.select(*KEYS, "p", "o", F.expr(f"__mask[{cell}]").alias("__m"), F.expr(f"__of[{cell}]").alias("__c"), F.expr(bit).alias("__b")).where("shiftright(__m, __b) & 1 = 1")
    met = hit.select(*KEYS, "p", "o", F.expr("__c[bit_count(__m & ~shiftleft(-1L, __b))]").alias("n"))
    d2 = sum(F.abs(F.col(f"o.d{a}")) for a in AXES).cast("int")
    return met.select(*KEYS, d2.alias("d2"), *[F.col(f"p.{a}").alias(a) for a in AXES], *[F.col(f"n.{a}").alias(f"n{a}") for a in AXES], *[F.col(f"p.{v}").alias(v) for v in values], *[F.col(f"n.{v}").alias(f"n_{v}") for v in values])


def distance() -> Column:
    return F.sqrt(F.col("d2").cast("double"))


def weight_inverse() -> Column:
    """2 / d."""
    return 2.0 / distance()


def weight_luma(value: str = "cy") -> Column:
    """2 / (d (1 + |difference of luminance|))."""
    return 2.0 / (distance() * (1.0 + F.abs(F.col(f"n_{value}") - F.col(value)) / 256.0))


def weight_bilateral(sigma_d: float, sigma_y: float, value: str = "cy") -> Column:
    """exp(-d^2 / 2 sigma_d^2) exp(-(difference of luminance)^2 / 2 sigma_y^2)."""
    dy = (F.col(f"n_{value}") - F.col(value)) / 256.0
    return F.exp(-F.col("d2") / (2.0 * sigma_d**2) - dy * dy / (2.0 * sigma_y**2))


def gaussian_edges(edges: DataFrame) -> DataFrame:
    """edges with w = exp(-d^2 / 2 s^2) / (degree of i * degree of j), s^2 = mean(d^2 / 4) / 3 of the block.

    Every edge is there in both directions, so the degree of the other end is a sum by that end; all sums stay inside the block's partition.
    """
    block = Window.partitionBy(*KEYS)
    raw = edges.withColumn("__s2", F.avg(F.col("d2") / 4.0).over(block) / 3.0).withColumn("w", F.exp(-F.col("d2") / (2.0 * F.col("__s2")))).drop("__s2")
    near = F.sum("w").over(Window.partitionBy(*KEYS, *AXES))
    far = F.sum("w").over(Window.partitionBy(*KEYS, "nx", "ny", "nz"))
    return raw.withColumn("__near", near).withColumn("__far", far).withColumn("w", F.col("w") / (F.col("__near") * F.col("__far"))).drop("__near", "__far")


def degrees(edges: DataFrame, weight: Column) -> DataFrame:
    """(keys, x, y, z, degree) of vertices with an edge."""
    return edges.groupBy(*KEYS, *AXES).agg(F.sum(weight).alias("degree"))


def laplacian(edges: DataFrame, weight: Column, loops: DataFrame | None = None, loop_weight: float = 2.0) -> DataFrame:
    """(keys, x, y, z, nx, ny, nz, l): minus the weight off the diagonal, the degree (and a loop's weight) on it.

    loops: (keys, x, y, z) of vertices with a loop.
    """
    off = edges.select(*KEYS, *AXES, "nx", "ny", "nz", (-weight).alias("l"))
    on = degrees(edges, weight).select(*KEYS, *AXES, *[F.col(a).alias(f"n{a}") for a in AXES], F.col("degree").alias("l"))
    if loops is not None:
        extra = loops.select(*KEYS, *AXES, *[F.col(a).alias(f"n{a}") for a in AXES], F.lit(loop_weight).alias("l"))
        on = on.unionByName(extra).groupBy(*KEYS, *AXES, "nx", "ny", "nz").agg(F.sum("l").alias("l"))
    return off.unionByName(on)


def components(points: DataFrame, size: int) -> DataFrame:
    """(keys, x, y, z, component): number of the component's least vertex in (x, y, z) order of the block.

    Components do not leave their blocks, so one shuffle deals whole blocks, CELL
    voxels a side at most, to tasks; a task's memory is bounded by its voxels.
    """
    cell = max(size, CELL)
    own = points.select("frame_id", *AXES, *block_of(size), *block_of(cell, names=("cell_x", "cell_y", "cell_z")))
    made = own.select(*KEYS, *AXES, F.lit(0).cast("long").alias("component")).schema

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[list(AXES)].to_numpy() % cell
        pdf = pdf[[*KEYS, *AXES]].copy()
        pdf["component"] = _labels(at, size, cell)
        return pdf

    return own.groupBy("frame_id", "cell_x", "cell_y", "cell_z").applyInPandas(label, made)


def _labels(at: np.ndarray, size: int, cell: int) -> np.ndarray:
    """The least number of each voxel's component: numbers spread to the 26 neighbours of the block until nothing changes."""
    blocks, inside = at // size, at % size
    place = (np.ravel_multi_index(blocks.T, (cell // size,) * 3), *inside.T)
    number = np.ravel_multi_index(inside.T, (size,) * 3)
    grid = np.full(((cell // size) ** 3, size, size, size), size**3, np.int64)
    grid[place] = number
    while True:
        spread = grid
        for axis in (1, 2, 3):
            padded = np.pad(spread, [(0, 0) if i != axis else (1, 1) for i in range(4)], constant_values=size**3)
            spread = np.minimum.reduce([np.take(padded, range(i, i + size), axis) for i in range(3)])
        if (spread[place] == number).all():
            return number
        number = spread[place]
        grid[place] = number


def component_centroids(labelled: DataFrame, weight: str | None = None) -> DataFrame:
    """(keys, component, n, gx, gy, gz): centroids, weighted by a column if named."""
    q = F.col(weight).cast("double") if weight else F.lit(1.0)
    return labelled.groupBy(*KEYS, "component").agg(F.count("*").alias("n"), *[(F.sum(q * F.col(a)) / F.sum(q)).alias(f"g{a}") for a in AXES])


def complete_graph(centroids: DataFrame) -> DataFrame:
    """(keys, i, j, w): 2 / distance between the different components of a block; coincident ones have no edge."""
    other = centroids.select(*KEYS, F.col("component").alias("j"), *[F.col(f"g{a}").alias(f"h{a}") for a in AXES])
    pairs = centroids.join(other, list(KEYS)).where(F.col("component") != F.col("j"))
    d = F.sqrt(sum((F.col(f"g{a}") - F.col(f"h{a}")) * (F.col(f"g{a}") - F.col(f"h{a}")) for a in AXES))
    return pairs.select(*KEYS, F.col("component").alias("i"), "j", d.alias("d")).where("d > 0").select(*KEYS, "i", "j", (2.0 / F.col("d")).alias("w"))
