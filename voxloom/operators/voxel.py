"""Voxel tables, blocks, and the pyramid of lowest coefficients in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.color import rgb_to_yuv
from voxloom.functions.space import AXES, BLOCK, block_of, morton

CHANNELS = ("cy", "cu", "cv")
#: Consecutive order keys whose lines make one frame of the voxel view.
ORDERS = 8_192


def voxel_view(lineitem: DataFrame, depth: int, orders: int = ORDERS, size: int | None = None) -> DataFrame:
    """One point a voxel from order lines: (frame_id, x, y, z, red, green, blue).

    The lines of ``orders`` consecutive order keys are a frame, so frames, and with
    them points, edges and coefficients, grow with the table. size: the lines are dealt by blocks of it, and
    the points have their block's key and lie with it, so that work on blocks deals nothing again.
    """
    n = 1 << depth
    at = lineitem.select(
        F.floor(F.col("l_orderkey") / orders).cast("int").alias("frame_id"),
        (F.col("l_partkey") % n).alias("x"),
        ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 3) % n).alias("y"),
        (F.col("l_quantity").cast("long") % n).alias("z"),
        ((F.col("l_orderkey") * 37) % 256).cast("int").alias("r"),
        ((F.col("l_partkey") * 11) % 256).cast("int").alias("g"),
        ((F.col("l_suppkey") * 53) % 256).cast("int").alias("b"),
    )
    block = () if size is None else BLOCK
    if size is not None:
        at = at.select("*", *block_of(size)).repartition("frame_id", *BLOCK)
    return at.groupBy("frame_id", *block, *AXES).agg(F.min("r").alias("red"), F.min("g").alias("green"), F.min("b").alias("blue"))


def with_yuv(points: DataFrame) -> DataFrame:
    return points.withColumns(rgb_to_yuv())


def with_blocks(points: DataFrame, size: int) -> DataFrame:
    return points.select("*", *block_of(size))


def block_counts(points: DataFrame, size: int) -> DataFrame:
    """(frame_id, block, n): points of each block."""
    return points.groupBy("frame_id", *block_of(size)).agg(F.count("*").alias("n"))


#: Bits of a place by which ranges are told apart: at most 4,096 ranges a frame.
RANGES = 12


def running_totals(rows: DataFrame, by: tuple[str, ...], place: str, bits: int, n: str = "n") -> DataFrame:
    """rows with ``before``: the sum of n over the rows of the same ``by`` at a smaller place (a number of that many bits).

    Sums of ranges of places are added up first, a few rows for each ``by``; inside a range, its own
    rows are added up, so no task sees more than a range of a frame.
    """
    own = rows.withColumn("__range", F.shiftright(place, max(0, bits - RANGES)))
    sums = own.groupBy(*by, "__range").agg(F.sum(n).alias("__sum"))
    sums = sums.withColumn("__start", F.sum("__sum").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__sum")).drop("__sum")
    inside = Window.partitionBy(*by, "__range").orderBy(place)
    return own.join(sums, [*by, "__range"]).withColumn("before", F.col("__start") + F.sum(n).over(inside) - F.col(n)).drop("__range", "__start")


def block_boundaries(points: DataFrame, size: int, depth: int) -> DataFrame:
    """(frame_id, block, start_row, end_row) in Morton order, rows counted from 1.

    Counts of blocks are summed in Morton order of the blocks, which gives the
    row ranges of the sorted cloud without sorting its points. Frames are apart.
    """
    bits = depth - (size.bit_length() - 1)
    counts = running_totals(block_counts(points, size).withColumn("m", morton(bits, BLOCK)), ("frame_id",), "m", 3 * bits)
    return counts.select("frame_id", *BLOCK, (F.col("before") + 1).alias("start_row"), (F.col("before") + F.col("n")).alias("end_row"))


def coefficient_positions(points: DataFrame, sizes: list[int], depth: int) -> DataFrame:
    """(frame_id, level, bx, b_y, bz, k, position): where each coefficient of the transform stands in its frame's channel, from 1.

    The lowest coefficients come first, then the levels from the coarsest, each in Morton order of its blocks
    and by k. Geometry alone gives the counts: a block of n cells has n - 1 coefficients beside the lowest.
    sizes: finest first.
    """
    cells, out, shift = points.select("frame_id", *AXES), None, 0
    for i, b in enumerate(sizes):
        shift += b.bit_length() - 1
        level, bits = len(sizes) - i, depth - shift
        blocks = cells.groupBy("frame_id", *block_of(b)).agg(F.count("*").alias("n"))
        keyed = blocks.withColumn("m", morton(bits, BLOCK)).withColumn("level", F.lit(level))
        part = keyed.select("frame_id", "level", F.lit(level).alias("group"), *BLOCK, "m", F.lit(1).alias("k"), (F.col("n") - 1).alias("n")).where("n > 0")
        out = part if out is None else out.unionByName(part)
        if level == 1:
            out = out.unionByName(keyed.select("frame_id", "level", F.lit(0).alias("group"), *BLOCK, "m", F.lit(0).alias("k"), F.lit(1).cast("long").alias("n")))
        cells = blocks.select("frame_id", *[F.col(k).alias(a) for k, a in zip(BLOCK, AXES, strict=True)])
    width = 3 * (depth - (sizes[0].bit_length() - 1))
    placed = out.withColumn("place", F.shiftleft(F.col("group").cast("long"), width).bitwiseOR(F.col("m")))
    counted = running_totals(placed, ("frame_id",), "place", width + len(sizes).bit_length())
    # A lowest coefficient is alone with its k of 0; others count from 1.
    each = counted.select("frame_id", "level", *BLOCK, "before", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return each.select("frame_id", "level", *BLOCK, (F.col("k") + F.col("i")).cast("int").alias("k"), (F.col("before") + F.col("i") + 1).alias("position"))


def dc_pyramid(points: DataFrame, sizes: list[int], channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(frame_id, level, x, y, z, q, channels): lowest coefficients after each level, finest level = len(sizes).

    The lowest coefficient of a block is sum(sqrt(q) a) / sqrt(sum(q)), connected or
    not, which makes each level a roll-up of the one below; sums are carried, so
    each level aggregates only the cells of the level before.
    """
    rows, out = points.select("frame_id", *AXES, F.lit(1).cast("long").alias("q"), *channels), None
    for i, b in enumerate(sizes):
        keys = block_of(b, names=AXES)
        rows = rows.groupBy("frame_id", *keys).agg(F.sum("q").alias("q"), *[F.sum(c).alias(c) for c in channels])
        level = rows.select("frame_id", F.lit(len(sizes) - i).alias("level"), *AXES, "q", *[(F.col(c) / F.sqrt("q")).alias(c) for c in channels])
        out = level if out is None else out.unionByName(level)
    return out


def block_energy(points: DataFrame, size: int, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(frame_id, block, n, and a channel's lowest coefficient and the energy of its others) by Parseval's identity."""
    exprs = []
    for c in channels:
        dc = F.sum(c) / F.sqrt(F.count("*"))
        exprs += [dc.alias(f"dc_{c}"), (F.sum(F.col(c) * F.col(c)) - dc * dc).alias(f"ac_{c}")]
    return points.groupBy("frame_id", *block_of(size)).agg(F.count("*").alias("n"), *exprs)


def violations(points: DataFrame, depth: int) -> DataFrame:
    """(frame_id, n, n_null, n_outside, n_repeated): rows of a frame without a coordinate or colour, beyond [0, 2^depth), and beyond the first of their voxel."""
    known = [F.col(c).isNotNull() for c in (*AXES, "red", "green", "blue")]
    whole = known[0] & known[1] & known[2] & known[3] & known[4] & known[5]
    outside = F.coalesce((F.least(*AXES) < 0) | (F.greatest(*AXES) >= 1 << depth), F.lit(False))
    voxels = points.groupBy("frame_id", *AXES).agg(F.count("*").alias("n"), F.sum((~whole).cast("long")).alias("n_null"), F.sum(outside.cast("long")).alias("n_outside"))
    return voxels.groupBy("frame_id").agg(*[F.sum(c).alias(c) for c in ("n", "n_null", "n_outside")], F.sum(F.col("n") - 1).alias("n_repeated"))
