"""Levels that experiments share: each is computed once, for all of them in one plan.

A level's input is the roll-up of the points to its finest cells, whatever levels lie
below, so a level is told by its graph, the bits that are rolled up before it and its
block size. Experiments are lists of such levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import ragft, spectral
from voxloom.operators.ragft import Columns
from voxloom.operators.voxel import CHANNELS
from voxloom.plans.levels import level_plan

#: Bits of the cells that hold all levels of the first pass.
BITS = 6


@dataclass(frozen=True)
class Run:
    """An experiment: its name, block sizes (as level_plan takes them) and graph."""

    name: str
    bsize: tuple[int, ...] | int
    multilevel: bool = True
    graph: str = "inverse"


@dataclass(frozen=True, order=True)
class Level:
    graph: str
    shift: int
    block: int

    @property
    def end(self) -> int:
        return self.shift + self.block.bit_length() - 1


def levels_of(run: Run, depth: int) -> list[Level]:
    """A run's levels, finest first."""
    bsize, out, shift = list(run.bsize) if isinstance(run.bsize, tuple) else run.bsize, [], 0
    for b in level_plan(bsize, depth, run.multilevel):
        out.append(Level(run.graph, shift, b))
        shift += b.bit_length() - 1
    return out


def distinct_levels(runs: list[Run], depth: int) -> list[Level]:
    return sorted({level for run in runs for level in levels_of(run, depth)})


def all_levels(points: DataFrame, levels: list[Level], channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Coefficients of all levels, k from 0 everywhere; ``level`` is the place in the list.

    Levels that end inside cells of 2^BITS voxels are made in one pass over these cells, coarser ones from roll-ups.
    """
    now = ragft.attributes(points, channels)
    near = [(i, x) for i, x in enumerate(levels) if x.end <= BITS]
    shifts = sorted({x.shift for _, x in near})

    def make(piece: Columns) -> Iterator[Columns]:
        coords, a = ragft._at(piece), np.stack([piece[v] for v in ragft.VALUES], 1)
        for s in shifts:
            order, first, count = spectral.grouped(coords, 1 << s)
            q = count.astype(float)
            cells = spectral.blocks_of(coords[order][first], 1 << s)
            values = np.add.reduceat(a[order], first, axis=0) / np.sqrt(q)[:, None]
            for i, x in near:
                if x.shift == s:
                    r = spectral.forward_level(cells, q, values, x.block, x.graph)
                    yield ragft._coefficients(i, r["key"], r["k"], r["c"], r["freq"], r["weight"])

    out = ragft._by_cells(ragft._with_cells(now, 1 << BITS), make, ragft.COEFFS) if near else None
    for i, x in enumerate(levels):
        if x.end > BITS:
            part = ragft.level_of(ragft.rolled_up(now, x.shift), [x.block], i, x.graph, True)
            out = part if out is None else out.unionByName(part)
    return out


def run_coefficients(points: DataFrame, runs: list[Run], depth: int, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(run, and the columns of ragft.forward): the coefficients of all runs (numbered from 0); a shared level is computed once and its rows repeated."""
    levels = distinct_levels(runs, depth)
    uses = []
    for number, run in enumerate(runs):
        own = levels_of(run, depth)
        uses += [(number, levels.index(x), len(own) - i, i == len(own) - 1) for i, x in enumerate(own)]
    # As many rows as the runs have levels.
    table = F.broadcast(points.sparkSession.createDataFrame(uses, "run int, level int, __level int, __lowest boolean"))
    each = all_levels(points, levels, channels).join(table, "level").where("k > 0 OR __lowest").withColumn("level", F.col("__level"))
    return each.select("run", *[f.split()[0] for f in ragft.COEFFS.split(", ")])
