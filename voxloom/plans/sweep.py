"""Sweeps: every experiment of a catalogue over frames and quantisation steps, as rate-distortion rows."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import codec, ragft, voxel
from voxloom.plans.catalog import STEPS
from voxloom.plans.shared import Run, run_coefficients
from voxloom.sources.ply import load_frames, write_metrics

#: Experiments whose names begin so (in any case) run on the degree-normalised Gaussian graph, all others on 2/d.
GAUSSIAN = "exp4"
#: Frames of a run; (run, frame) is one number while runs are coded together.
FRAMES = 100_000


def graph_of(experiment: str) -> str:
    return "gaussian" if experiment.lower().startswith(GAUSSIAN) else "inverse"


def measure(points: DataFrame, experiment: str, bsize: int | list[int], depth: int, multilevel: bool = True, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(frame, step, experiment, nvox, mse, psnr, bytes, seconds) of coloured points, kept until the caller unpersists it.

    One job does all frames and steps; seconds is its wall time divided by the number of frames.
    """
    return measure_together(points, [Run(experiment, bsize if isinstance(bsize, int) else tuple(bsize), multilevel, graph_of(experiment))], depth, steps)


def measure_together(points: DataFrame, runs: list[Run], depth: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """measure of several runs over the same points: one job, in which a level that runs share is computed once.

    seconds is the job's wall time divided by the number of runs and frames. Values that are not finite, and
    weights and frequencies below 0, are counted in the same job and are an error.
    """
    began = time.perf_counter()
    made, seen = ragft.observed(run_coefficients(voxel.with_yuv(points), runs, depth))
    coeffs = made.withColumn("frame_id", (F.col("run") * FRAMES + F.col("frame_id")).cast("int"))
    rows = codec.rate_distortion(coeffs, steps).persist(StorageLevel.MEMORY_AND_DISK)
    parts = rows.select("frame_id").distinct().count()
    spent = (time.perf_counter() - began) / max(1, parts)
    if odd := {n: v for n, v in seen.get.items() if n != "n" and v}:
        raise ArithmeticError(f"coefficients that cannot be right: {odd}")
    name = F.array(*[F.lit(r.name) for r in runs])[F.expr(f"frame_id div {FRAMES}").cast("int")]
    return rows.select((F.col("frame_id") % FRAMES).alias("frame"), "step", name.alias("experiment"), "nvox", "mse", "psnr", "bytes", F.lit(spent).alias("seconds"))


def run(spark: SparkSession, experiments: Iterable[tuple[str, str, str, list[int], bool]], frames: list[int], path: str, root: str = ".", steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Append the rows of each experiment (dataset, sequence, exp_name, bsize, multilevel) to path; returns all of path.

    Sequences come one after the other, all experiments of a sequence in one job over its frames and steps.
    """
    of: dict[tuple[str, str], list[Run]] = {}
    for dataset, sequence, name, bsize, multilevel in experiments:
        # An experiment without levels names one size of block.
        of.setdefault((dataset, sequence), []).append(Run(name, tuple(bsize) if multilevel else bsize[0], multilevel, graph_of(name)))
    for (dataset, sequence), runs in of.items():
        points, depth = load_frames(spark, dataset, sequence, frames, root)
        rows = measure_together(points, runs, depth, steps)
        try:
            write_metrics(rows.withColumns({"dataset": F.lit(dataset), "sequence": F.lit(sequence)}), path)
        finally:
            rows.unpersist()
    return spark.read.parquet(path)
