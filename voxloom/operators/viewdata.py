"""Tables ready to plot; drawing is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.space import AXES


def axis_extents(points: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """(keys, least and greatest coordinate of each axis, centroid)."""
    return points.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def coeff_magnitudes(original: DataFrame, modified: DataFrame, keys: tuple[str, ...] = ("frame_id", "bx", "b_y", "bz", "k")) -> DataFrame:
    """(keys, channel, original, modified): magnitudes side by side, a row for each channel."""
    other = modified.select(*keys, *[F.col(c).alias(f"m{c}") for c in ("c0", "c1", "c2")])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.abs(f"c{i}").alias("original"), F.abs(f"mc{i}").alias("modified")) for i in range(3)])).alias("e")
    return original.join(other, list(keys)).select(*keys, each).select(*keys, "e.*")


def arrows(directed: DataFrame, keys: tuple[str, ...] = ("frame_id", "bx", "b_y", "bz")) -> DataFrame:
    """(keys, mx, my, mz, anchor): plain mean arrow of the non-zero directions and where to draw it.

    A direction is a step to one of the 26 neighbours by its length. Steps of each length are summed as whole numbers, so
    that directions which cancel have no mean (null) in whatever order their rows come.
    """
    pointed, length = F.col("weight") > 0, sum(F.abs(F.signum(f"u{a}")) for a in AXES)
    steps = [F.sum(F.when(pointed & (length == d2), F.signum(f"u{a}").cast("long")).otherwise(0)).alias(f"s{a}{d2}") for a in AXES for d2 in (1, 2, 3)]
    sums = directed.groupBy(*keys).agg(F.count_if(pointed).alias("n"), *steps, *[F.avg(a).alias(f"anchor_{a}") for a in AXES])
    m = sums.withColumns({f"s{a}": F.try_divide(F.col(f"s{a}1") + F.col(f"s{a}2") / math.sqrt(2) + F.col(f"s{a}3") / math.sqrt(3), F.col("n")) for a in AXES})
    norm = F.sqrt(sum(F.col(f"s{a}") * F.col(f"s{a}") for a in AXES))
    return m.select(*keys, *[F.try_divide(F.col(f"s{a}"), norm).alias(f"m{a}") for a in AXES], *[f"anchor_{a}" for a in AXES])
