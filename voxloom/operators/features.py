"""Block features: gradients, directions, self loops, clustering inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.space import AXES, block_of
from voxloom.operators.graph import KEYS, distance, neighbour_edges, weight_inverse
from voxloom.operators.voxel import CHANNELS

JUMP = 0.02


def block_metrics(points: DataFrame, size: int) -> DataFrame:
    """(keys, n, m1..m4): mean and deviation of the non-zero luminance differences over directed edges, and of the luminance.

    One sample has deviation 0; a block without differences has null m1 and m2.
    """
    edges = neighbour_edges(points, size, itself=True)
    g = F.abs(F.col("n_cy") - F.col("cy")) / 256.0
    g, own = F.when((F.col("d2") > 0) & (g != 0), g), F.when(F.col("d2") == 0, F.col("cy"))
    deviation = lambda c: F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))
    of_block = edges.select(*KEYS, g.alias("g"), own.alias("own")).groupBy(*KEYS)
    return of_block.agg(F.count("own").alias("n"), F.avg("g").alias("m1"), deviation("g").alias("m2"), F.avg("own").alias("m3"), deviation("own").alias("m4"))


def vertices(points: DataFrame, size: int, values: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """(keys, x, y, z, values, near, degree, jump): of each point, sums of 1/d and of 2/d over its edges, and its jump with its end.

    The jump of a vertex is the least luminance difference towards a neighbour
    (its own luminance less the neighbour's); of equal ones the first neighbour
    in (x, y, z) order counts. It is null for a point without neighbours.
    """
    # In steps of a millionth, so that equal jumps are equal whatever the order of their sums.
    diff = F.floor((F.col("cy") - F.col("n_cy")) / 256.0 * 1e6 + 0.5) / 1e6
    there = F.col("d2") > 0
    held = tuple(dict.fromkeys(("cy", *values)))
    rows = neighbour_edges(points, size, held, itself=True, dealt=dealt).select(*KEYS, *AXES, *values, F.when(there, distance()).alias("d"), F.when(there, F.struct(diff.alias("g"), "nx", "ny", "nz", "d2")).alias("s"))
    return rows.groupBy(*KEYS, *AXES, *values).agg(F.coalesce(F.sum(1.0 / F.col("d")), F.lit(0.0)).alias("near"), F.coalesce(F.sum(2.0 / F.col("d")), F.lit(0.0)).alias("degree"), F.min("s").alias("jump"))


def _pointed(rows: DataFrame) -> DataFrame:
    """rows of vertices with weight and unit direction of the jumps, zero without one above JUMP."""
    steep = (F.abs("jump.g") > JUMP) & (F.col("jump.g") < 0)
    unit = {f"u{a}": F.when(steep, (F.col(a) - F.col(f"jump.n{a}")) / F.sqrt(F.col("jump.d2").cast("double"))).otherwise(0.0) for a in AXES}
    return rows.withColumns({"weight": F.when(steep, F.abs("jump.g")).otherwise(0.0), **unit})


def directions(points: DataFrame, size: int) -> DataFrame:
    """(keys, x, y, z, weight, ux, uy, uz): where each vertex's steepest luminance jump points, zero without one above JUMP."""
    return _pointed(vertices(points, size)).select(*KEYS, *AXES, "weight", "ux", "uy", "uz")


def mean_direction(directed: DataFrame) -> DataFrame:
    """(keys, mx, my, mz): unit mean of the directions by weight; null where no vertex has one."""
    m = directed.groupBy(*KEYS).agg(*[F.try_divide(F.sum(F.col("weight") * F.col(f"u{a}")), F.sum("weight")).alias(f"s{a}") for a in AXES])
    norm = F.sqrt(sum(F.col(f"s{a}") * F.col(f"s{a}") for a in AXES))
    return m.select(*KEYS, *[F.try_divide(F.col(f"s{a}"), norm).alias(f"m{a}") for a in AXES])


def _scored(rows: DataFrame) -> DataFrame:
    """rows of vertices with pos, their place by degree among the n of their block, and dot, the offset from the block's centroid projected on its mean direction."""
    block = Window.partitionBy(*KEYS)
    known = _pointed(rows).withColumn("near", F.round("near", 6))
    sums = {f"s{a}": F.try_divide(F.sum(F.col("weight") * F.col(f"u{a}")).over(block), F.sum("weight").over(block)) for a in AXES}
    ranked = known.select("*", F.row_number().over(block.orderBy("near", *AXES)).alias("pos"), F.count("*").over(block).alias("n"), *[F.avg(a).over(block).alias(f"g{a}") for a in AXES], *[c.alias(n) for n, c in sums.items()])
    norm = F.sqrt(sum(F.col(f"s{a}") * F.col(f"s{a}") for a in AXES))
    means = ranked.select("*", *[F.try_divide(F.col(f"s{a}"), norm).alias(f"m{a}") for a in AXES])
    # An unknown direction sorts as equal: the position then decides.
    return means.withColumn("dot", F.coalesce(F.round(sum((F.col(a) - F.col(f"g{a}")) * F.col(f"m{a}") for a in AXES), 6), F.lit(0.0)))


#: Vertices that may have the loop of their block.
_LOW = "pos <= round(0.2D * n)"


def _loops(rows: DataFrame) -> DataFrame:
    """(keys, x, y, z): the vertex of each block for a self loop, from rows of vertices."""
    chosen = _scored(rows).where(_LOW).groupBy(*KEYS).agg(F.min(F.struct("dot", "pos", *AXES)).alias("s"))
    return chosen.select(*KEYS, *[F.col(f"s.{a}").alias(a) for a in AXES])


def looped_points(points: DataFrame, size: int, values: tuple[str, ...] = CHANNELS, dealt: bool = False) -> DataFrame:
    """(keys, x, y, z, values, looped): the points, and whether their block's self loop is theirs, still in the tasks where the edges are made."""
    best = F.min(F.when(F.expr(_LOW), F.struct("dot", "pos"))).over(Window.partitionBy(*KEYS))
    return _scored(vertices(points, size, values, dealt)).withColumn("__best", best).select(*KEYS, *AXES, *values, F.coalesce(F.col("__best.pos") == F.col("pos"), F.lit(False)).alias("looped"))


def selfloop_vertices(points: DataFrame, size: int) -> DataFrame:
    """(keys, x, y, z): at most one vertex of a block for a self loop.

    Of the fifth of the vertices with the least degree (1/d summed), the one whose
    offset from the block's centroid projects least on the mean direction; without a
    direction, the one of least degree. Blocks of which a fifth rounds to 0 have
    none. Ties go by (x, y, z).
    """
    return _loops(vertices(points, size))


def block_records(points: DataFrame, size: int) -> DataFrame:
    """(keys, n, m1..m4, points, edges, selfloop_vertex): all that is known of a block in one row.

    points: (x, y, z, channels, degree) in (x, y, z) order, degrees by 2/d; edges: (i, j, w)
    by places in points, in order; selfloop_vertex: a place in points, or null. A row holds
    at most size^3 points and 26 edges a point.
    """
    edges = neighbour_edges(points, size, CHANNELS, itself=True)
    degree = F.sum(F.when(F.col("d2") > 0, weight_inverse()).otherwise(0.0)).alias("degree")
    voxels = edges.groupBy(*KEYS, *AXES, *CHANNELS).agg(degree).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*AXES, *CHANNELS, "degree"))).alias("points"))
    ends = edges.where("d2 > 0").groupBy(*KEYS).agg(F.collect_list(F.struct(F.struct(*AXES).alias("a"), F.struct(*[F.col(f"n{a}").alias(a) for a in AXES]).alias("b"), weight_inverse().alias("w"))).alias("ends"))
    loops = selfloop_vertices(points, size).select(*KEYS, F.struct(*AXES).alias("loop"))
    rows = block_metrics(points, size).join(voxels, list(KEYS)).join(ends, list(KEYS), "left").join(loops, list(KEYS), "left")
    rows = rows.withColumn("places", F.transform("points", lambda p: F.struct(*[p[a].alias(a) for a in AXES])))
    place = lambda at: (F.array_position("places", at) - 1).cast("int")
    listed = F.sort_array(F.transform(F.coalesce("ends", F.array()), lambda e: F.struct(place(e["a"]).alias("i"), place(e["b"]).alias("j"), e["w"].alias("w"))))
    return rows.select(*KEYS, "n", "m1", "m2", "m3", "m4", "points", listed.alias("edges"), place(F.col("loop")).alias("selfloop_vertex"))


def normalised(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose first two columns are known, each column divided by its norm over all rows."""
    known = table.dropna(subset=columns[:2])
    norms = known.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"norm_{c}") for c in columns])
    return known.join(F.broadcast(norms), F.lit(True)).select(*[x for x in table.columns if x not in columns], *[F.try_divide(F.col(c), F.col(f"norm_{c}")).alias(c) for c in columns])


def nearest_centroid(table: DataFrame, centroids: list[tuple[float, ...]], columns: list[str]) -> DataFrame:
    """table with cluster (from 0) and its distance; the least number of equal distances. Centroids are literals of the plan."""
    dists = [F.round(F.sqrt(sum((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, point, strict=True))), 9) for point in centroids]
    best = F.array_min(F.array(*[F.struct(d.alias("distance"), F.lit(i).alias("cluster")) for i, d in enumerate(dists)]))
    return table.withColumn("__best", best).select(*table.columns, F.col("__best.cluster").alias("cluster"), F.col("__best.distance").alias("distance"))


def nearest_rows(table: DataFrame, centroids: list[tuple[float, ...]], columns: list[str], ids: list[str], k: int = 3) -> DataFrame:
    """(cluster, rank, ids, distance): the k rows nearest to each centroid; ties by the ids.

    Each centroid's rows are sorted and cut by a limit of their own, so no task holds a centroid's whole list.
    """
    out = None
    for i, point in enumerate(centroids):
        d = F.round(F.sqrt(sum((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, point, strict=True))), 9)
        best = table.select(*ids, d.alias("distance")).orderBy("distance", *ids).limit(k)
        ranked = best.select(F.lit(i).alias("cluster"), F.row_number().over(Window.partitionBy(F.lit(i)).orderBy("distance", *ids)).alias("rank"), *ids, "distance")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def kmeans_blocks(table: DataFrame, columns: list[str], k: int = 3, seed: int = 7) -> DataFrame:
    """table with cluster by k-means over the columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(table)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(rows).transform(rows).drop("__v")


def histogram(table: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts of width_bucket over [low, high); bin 0 is below, bins + 1 above."""
    return table.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
