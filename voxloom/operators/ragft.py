"""The region-adaptive graph Fourier transform over block levels, forward and inverse.

Levels are run in spans: a cell as large as the span's coarsest block holds whole
blocks of all its levels, and its points do not depend on other cells. Rows are dealt
to tasks by cell and sorted there, and a task cuts its stream of rows between
cells, about POINTS at a time; blocks of one size are stacked across all cells and frames of such a
piece, so the work is that of its blocks, however few points a cell has. A span's input is the
roll-up of the points to its finest cells, in closed form, so spans do not wait for each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voxloom.functions.space import AXES, BLOCK
from voxloom.operators import spectral
from voxloom.operators.voxel import CHANNELS
from voxloom.plans.levels import level_plan, spans

COEFFS = "frame_id int, level int, bx long, b_y long, bz long, k int, c0 double, c1 double, c2 double, freq double, weight double"
POINTS_OUT = "frame_id int, x long, y long, z long, c0 double, c1 double, c2 double"
_CELL = ("cell_x", "cell_y", "cell_z")
_KEYS = ("frame_id", *_CELL)
VALUES = ("c0", "c1", "c2")
#: Rows that a task gathers before it cuts (whole cells are never cut), and voxels of a span's edge.
POINTS, MOST = 50_000, 64

Columns = dict[str, np.ndarray]


def _with_cells(rows: DataFrame, product: int) -> DataFrame:
    shift = product.bit_length() - 1
    return rows.select("*", *[F.shiftright(F.col(a).cast("long"), shift).alias(c) for a, c in zip(AXES, _CELL, strict=True)])


def _pieces(batches: Iterator[pa.RecordBatch], points: int = POINTS) -> Iterator[Columns]:
    """Whole cells of a stream that is sorted by cell, ``points`` rows or more at a time."""
    held: list[Columns] = []
    rows, wait = 0, points
    for batch in batches:
        held.append({n: batch.column(n).to_numpy() for n in batch.schema.names})
        rows += batch.num_rows
        if rows < wait:
            continue
        now = _joined(held)
        keys = np.stack([now[k] for k in _KEYS], 1)
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
        if len(ends):
            cut = ends[-1] + 1
            yield {n: c[:cut] for n, c in now.items()}
            now, rows, wait = {n: c[cut:] for n, c in now.items()}, rows - cut, points
        else:
            wait = 2 * rows
        held = [now]
    if rows:
        yield _joined(held)


def _joined(parts: list[Columns]) -> Columns:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def _batches(columns: Columns, schema: str) -> Iterator[pa.RecordBatch]:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    whole = pa.RecordBatch.from_arrays([pa.array(columns[n]).cast(types[t]) for n, t in fields], [n for n, _ in fields])
    for at in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(at, 1 << 16)


def _by_cells(rows: DataFrame, make: Callable[[Columns], Iterator[Columns]], schema: str) -> DataFrame:
    """make over pieces of whole cells; rows have the columns of _KEYS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            for columns in make(piece):
                yield from _batches(columns, schema)

    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, schema)


def _at(columns: Columns, names: tuple[str, ...] = AXES) -> np.ndarray:
    return np.stack([columns["frame_id"].astype(np.int64), *(columns[n] for n in names)], 1)


def _coefficients(level: int, key: np.ndarray, k: np.ndarray, c: np.ndarray, freq: np.ndarray, weight: np.ndarray) -> Columns:
    return {"frame_id": key[:, 0], "level": np.full(len(k), level), **{n: key[:, 1 + i] for i, n in enumerate(BLOCK)}, "k": k, **{n: c[:, i] for i, n in enumerate(VALUES)}, "freq": freq, "weight": weight}


def rolled_up(points: DataFrame, shift: int, values: tuple[str, ...] = VALUES) -> DataFrame:
    """(frame_id, x, y, z, q, values) of cells 2^shift voxels a side: points of each and their lowest coefficients, sum(c) / sqrt(q)."""
    if not shift:
        return points.select("frame_id", *AXES, F.lit(1.0).alias("q"), *values)
    sums = points.groupBy("frame_id", *[F.shiftright(a, shift).alias(a) for a in AXES]).agg(F.count("*").cast("double").alias("q"), *[F.sum(v).alias(v) for v in values])
    return sums.select("frame_id", *AXES, "q", *[(F.col(v) / F.sqrt("q")).alias(v) for v in values])


def level_of(rows: DataFrame, sizes: list[int], level: int, graph: str, lowest: bool, most: int = MOST) -> DataFrame:
    """Coefficients of the levels ``level``, level - 1, ... of rolled-up rows; sizes are those levels' blocks, finest first."""

    def make(piece: Columns) -> Iterator[Columns]:
        coords, q, a = _at(piece), piece["q"], np.stack([piece[v] for v in VALUES], 1)
        for i, b in enumerate(sizes):
            r = spectral.forward_level(coords, q, a, b, graph)
            keep = slice(None) if lowest and i == len(sizes) - 1 else r["k"] > 0
            yield _coefficients(level - i, r["key"][keep], r["k"][keep], r["c"][keep], r["freq"][keep], r["weight"][keep])
            coords, q, a = r["key"][r["first"]], r["weight"][r["first"]], r["c"][r["first"]]

    return _by_cells(_with_cells(rows, int(np.prod(sizes))), make, COEFFS)


def attributes(points: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """points as (frame_id, x, y, z, c0, c1, c2)."""
    return points.select(F.col("frame_id").cast("int").alias("frame_id"), *[F.col(a).cast("long").alias(a) for a in AXES], *[F.col(c).cast("double").alias(v) for c, v in zip(channels, VALUES, strict=True)])


def forward(points: DataFrame, bsize: int | list[int], depth: int, multilevel: bool = True, channels: tuple[str, ...] = CHANNELS, most: int = MOST, graph: str = "inverse") -> DataFrame:
    """(frame_id, level, bx, b_y, bz, k, c0..c2, freq, weight) of points with three attribute columns.

    k = 0 rows are there only at the coarsest level; finer ones are promoted. Level
    len(sizes) is the finest. graph: a name of spectral.GRAPHS.
    """
    sizes = level_plan(bsize, depth, multilevel)
    now, out, level, shift = attributes(points, channels), None, len(sizes), 0
    groups = spans(sizes, most)
    for g, span in enumerate(groups):
        part = level_of(rolled_up(now, shift), span, level, graph, g == len(groups) - 1)
        out = part if out is None else out.unionByName(part)
        level, shift = level - len(span), shift + int(np.prod(span)).bit_length() - 1
    return out


def _inverse_cells(span: list[int], finest: int, graph: str):
    """The levels of a span undone over whole cells, coarsest first. Rows of level 0 are the geometry."""

    def make(piece: Columns) -> Iterator[Columns]:
        geo = piece["level"] == 0
        coords, q = [_at(piece)[geo]], [piece["weight"][geo]]
        if not len(coords[0]):
            return
        for b in span:
            order, first, _ = spectral.grouped(coords[-1], b)
            coords.append(spectral.blocks_of(coords[-1][order][first], b))
            q.append(np.add.reduceat(q[-1][order], first))
        value = None
        for i in range(len(span) - 1, -1, -1):
            own = np.flatnonzero(piece["level"] == finest - i)
            at = _at(piece)[own]
            own = own[np.lexsort((piece["k"][own], *at.T[::-1]))]
            part, low = np.stack([piece[v][own] for v in VALUES], 1), piece["k"][own] == 0
            order, first, _ = spectral.grouped(coords[i], span[i])
            c = np.empty((len(order), 3))
            if value is None:
                c[:] = part
            else:
                rest = np.ones(len(order), bool)
                rest[first] = False
                # The coarser level's values are in the order of its own blocks.
                back, _, _ = spectral.grouped(coords[i + 1], span[i + 1])
                up = np.empty_like(value)
                up[back] = value
                c[first], c[rest] = up, part[~low]
            value = spectral.inverse_level(coords[i], q[i], c, span[i], graph)
        order, _, _ = spectral.grouped(coords[0], span[0])
        at = coords[0][order]
        yield {"frame_id": at[:, 0], **{a: at[:, 1 + i] for i, a in enumerate(AXES)}, **{v: value[:, i] for i, v in enumerate(VALUES)}}

    return make


def inverse(coeffs: DataFrame, geometry: DataFrame, bsize: int | list[int], depth: int, multilevel: bool = True, most: int = MOST, graph: str = "inverse") -> DataFrame:
    """(frame_id, x, y, z, c0, c1, c2): attributes of the geometry's points from their coefficients."""
    sizes = level_plan(bsize, depth, multilevel)
    groups = spans(sizes, most)
    starts = [sum(int(np.prod(s)).bit_length() - 1 for s in groups[:g]) for g in range(len(groups))]
    voxels = geometry.select(F.col("frame_id").cast("int").alias("frame_id"), *[F.col(a).cast("long").alias(a) for a in AXES])
    decoded, coarsest = None, 1
    for g in range(len(groups) - 1, -1, -1):
        span = groups[g]
        finest, product = coarsest + len(span) - 1, int(np.prod(span))
        grid = rolled_up(voxels, starts[g], ()).select("frame_id", F.lit(0).alias("level"), *AXES, F.lit(0).alias("k"), F.col("q").alias("weight"), *[F.lit(0.0).alias(v) for v in VALUES])
        own = coeffs.where(F.col("level").between(coarsest, finest)).select("frame_id", "level", *[F.col(b).alias(a) for b, a in zip(BLOCK, AXES, strict=True)], "k", "weight", *VALUES)
        if decoded is not None:
            # The decoded cells of the coarser span are this span's lowest coefficients.
            own = own.unionByName(decoded.select("frame_id", F.lit(coarsest).alias("level"), *AXES, F.lit(0).alias("k"), F.lit(0.0).alias("weight"), *VALUES))
        rows = _with_cells(grid, product)
        # From a block of a level to its cell: the sizes between are shifted away.
        shift = F.lit(0)
        for level in range(coarsest, finest + 1):
            between = product // int(np.prod(span[: finest - level + 1]))
            shift = F.when(F.col("level") == level, between.bit_length() - 1).otherwise(shift)
        keyed = own.withColumn("__s", shift).select("*", *[F.expr(f"shiftright({a}, __s)").alias(c) for a, c in zip(AXES, _CELL, strict=True)]).drop("__s")
        decoded = _by_cells(rows.unionByName(keyed), _inverse_cells(span, finest, graph), POINTS_OUT)
        coarsest = finest + 1
    return decoded


def block_gft(blocks: DataFrame, size: int, loops: DataFrame | None = None) -> DataFrame:
    """(frame_id, bx, b_y, bz, k, freq, c0..c2) of the plain (not weighted by q) basis of every block, with optional self loops of weight 2.

    blocks: (frame_id, x, y, z, c0, c1, c2); loops: (frame_id, x, y, z).
    """
    rows = blocks.select(F.col("frame_id").cast("int").alias("frame_id"), *[F.col(a).cast("long").alias(a) for a in AXES], *VALUES)
    marked = rows.withColumn("loop", F.lit(0.0)) if loops is None else rows.join(loops.select("frame_id", *AXES, F.lit(2.0).alias("loop")), ["frame_id", *AXES], "left").fillna(0.0, ["loop"])

    def make(piece: Columns) -> Iterator[Columns]:
        coords = _at(piece)
        order, first, count = spectral.grouped(coords, size)
        v, a, loop = coords[order], np.stack([piece[c] for c in VALUES], 1)[order], piece["loop"][order]
        out, freq = a.astype(float).copy(), np.zeros(len(v))
        looped = np.add.reduceat(loop, first) > 0
        for mark in (False, True):
            # A lone point keeps its value; with a loop, the loop is its frequency.
            chosen = looped == mark
            for part in spectral.stacks(first[chosen], count[chosen]):
                u, f = spectral.basis(spectral.neighbour_weights(v[part][..., 1:]), np.ones(part.shape), loop[part] if mark else None)
                out[part], freq[part] = u @ a[part], f
        lone = first[count == 1]
        freq[lone] = loop[lone]
        yield _coefficients(1, spectral.blocks_of(v, size), np.arange(len(v)) - np.repeat(first, count), out, freq, np.ones(len(v)))

    return _by_cells(_with_cells(marked, size), make, COEFFS)


def observed(coeffs: DataFrame, name: str = "transform") -> tuple[DataFrame, Observation]:
    """(coeffs, an observation of them): rows, rows with NaN or infinite values, and negative weights and frequencies, counted while the rows are used."""
    seen = Observation(name)
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    odd = bad("c0") | bad("c1") | bad("c2") | bad("freq") | bad("weight")
    count = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).alias(n)
    return coeffs.observe(seen, F.count(F.lit(1)).alias("n"), count(odd, "n_not_finite"), count(F.col("weight") <= 0, "n_weight"), count(F.col("freq") < 0, "n_frequency")), seen
