import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from voxloom import oracles, queries
from voxloom.functions.color import rgb_to_yuv, yuv_to_rgb
from voxloom.operators import codec, features, ragft, spectral, voxel
from voxloom.plans import catalog
from voxloom.plans.levels import level_plan, spans
from voxloom.sources import ply


def cloud(spark, points):
    return voxel.with_yuv(spark.createDataFrame([(0, *p, (7 * i) % 256, (31 * i) % 256, (97 * i) % 256) for i, p in enumerate(points)], "frame_id int, x long, y long, z long, red int, green int, blue int"))


def test_level_plan():
    assert level_plan(2, 6) == [2] * 6
    assert level_plan([2, 4], 3) == [4, 2]
    assert level_plan(8, 6, multilevel=False) == [8]
    for bad in ((3, 6), (1, 6), (4, 5), ([4, 4], 3)):
        with pytest.raises(ValueError):
            level_plan(*bad)
    assert spans([2, 2, 2, 4, 16], 8) == [[2, 2, 2], [4], [16]]


def test_colour_round_trip(spark):
    rows = spark.createDataFrame([(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)], "red int, green int, blue int")
    back = rows.withColumns(rgb_to_yuv()).select("red", "green", "blue", *[c.alias(f"{n}2") for n, c in yuv_to_rgb().items()])
    # Pure red and pure blue leave the range of the colour differences and are clipped.
    assert not back.where("abs(red - red2) > 1 OR abs(green - green2) > 1 OR abs(blue - blue2) > 1").count()
    assert back.where("red <> red2 OR green <> green2 OR blue <> blue2").count() <= 2


def test_every_colour_comes_back_without_clipping(spark):
    rows = spark.range(1 << 24).selectExpr("cast(id >> 16 AS int) AS red", "cast((id >> 8) & 255 AS int) AS green", "cast(id & 255 AS int) AS blue")
    back = lambda clip: rows.withColumns(rgb_to_yuv(clip=clip)).select("red", "green", "blue", *[c.alias(f"{n}2") for n, c in yuv_to_rgb().items()]).where("red <> red2 OR green <> green2 OR blue <> blue2")
    assert not back(False).count()
    assert sorted(tuple(x)[:3] for x in back(True).collect()) == [(0, 0, 255), (1, 0, 255), (255, 0, 0), (255, 0, 1)]


def test_round_trip_query_keeps_pure_colours(spark, tmp_path):
    from voxloom import queries

    # 37 * 83, 53 * 227 and 11 * 163 leave 255, 255 and 1.
    rows = [(0, 0, 227, 1, 5.0), (83, 0, 0, 1, 7.0), (256, 163, 227, 1, 9.0), (7, 9, 11, 2, 3.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {tuple(r) for r in queries.points(spark, str(tmp_path)).select(*queries.VOXEL, "red", "green", "blue").collect()}
    assert {r[4:] for r in want} >= {(0, 0, 255), (255, 0, 0), (0, 1, 255)}
    assert {tuple(r) for r in queries.yuv_roundtrip(spark, str(tmp_path)).collect()} == want


def test_pair_has_known_spectrum():
    rows, freq = spectral.block_basis(np.array([[[0, 0, 0], [1, 0, 0]]]), np.ones((1, 2)))
    assert np.allclose(freq, [[0, 4]]) and np.allclose(rows[0, 0], 2**-0.5)


@pytest.mark.parametrize("seed", range(6))
def test_bases_are_orthonormal(seed):
    r = np.random.default_rng(seed)
    v = np.unique(r.integers(0, 8, (12, 3)), axis=0)
    q = r.integers(1, 9, len(v)).astype(float)
    rows, freq = spectral.block_basis(v[None], q[None])
    assert np.allclose(rows[0] @ rows[0].T, np.eye(len(v)), atol=1e-9)
    assert np.allclose(rows[0, 0], np.sqrt(q / q.sum()))


@pytest.mark.parametrize("sizes,depth", [([2, 2, 2], 3), ([2, 4], 3), ([8], 3), ([2, 2], 3)])
def test_transform_round_trip(spark, sizes, depth):
    r = np.random.default_rng(depth)
    own = cloud(spark, np.unique(r.integers(0, 1 << depth, (60, 3)), axis=0).tolist())
    coeffs = ragft.forward(own, sizes, depth)
    assert coeffs.count() == own.count()
    back = ragft.inverse(coeffs, own, sizes, depth).join(own, ["x", "y", "z"]).collect()
    assert len(back) == own.count() and max(abs(b["c0"] - b["cy"]) + abs(b["c2"] - b["cv"]) for b in back) < 1e-6
    energy = lambda df, c: sum(x[0] ** 2 for x in df.select(c).collect())
    assert abs(energy(coeffs, "c1") - energy(own, "cu")) < 1e-3


def test_forward_ignores_row_order(spark):
    r = np.random.default_rng(1)
    p = np.unique(r.integers(0, 8, (40, 3)), axis=0)
    own = cloud(spark, p.tolist())
    a, b = (sorted(map(tuple, ragft.forward(x, 2, 3).collect())) for x in (own, own.orderBy("cy")))
    assert np.allclose(np.array(a, float), np.array(b, float))


def test_run_length_bits():
    assert codec.run_length_bits([0] * 4000) < 200 < codec.run_length_bits([9] * 400) < codec.run_length_bits([200, -150] * 200)
    assert codec.run_length_bits([]) == 0


def test_catalogue(spark):
    assert catalog.frames(spark).count() == 4 * 300 + 318 + 216 + 245 + 216 + 207
    assert catalog.experiments(spark).where("size(bsize) > 0").count() > 60
    path, depth = catalog.frame_path("8iVFBv2", "loot", 1)
    assert path.endswith("loot_vox10_1000.ply") and depth == 10
    for bad in (("x", "loot", 1), ("MVUB", "phil9", 246)):
        with pytest.raises(ValueError):
            catalog.frame_path(*bad)


def test_ply_round_trip(spark, tmp_path):
    own = spark.createDataFrame([(0, x, 5, 2, 1, 2, 3) for x in range(9)], "frame_id int, x long, y long, z long, red int, green int, blue int")
    faces = spark.createDataFrame([(0, 1, 2)], "i int, j int, k int")
    ply.write_ply(own, str(tmp_path / "a.ply"), 1023, faces)
    back = ply.read_ply(spark, str(tmp_path / "a.ply"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, own.collect()))
    assert ply.depth_of(spark, str(tmp_path / "a.ply")) == 10


def test_stream_of_frames(spark, tmp_path):
    from voxloom.streaming.frames import transform_frames

    own = spark.createDataFrame([(f, x, y, 1, x, y, 9) for f in (0, 1) for x in range(4) for y in range(3)], "frame_id int, x long, y long, z long, red int, green int, blue int")
    own.write.parquet(str(tmp_path / "in"))
    transform_frames(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 2, 2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("frame_id").count().collect()[0][1] == 12


SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", ["dc_pyramid", "block_boundaries", "gaussian_weights", "selfloop_laplacian", "mean_arrow", "block_energy", "block_spectrum_trace", "complete_graph_weights", "ragft_roundtrip", "psnr_dc", "topk_per_centroid", "coefficient_order", "ragft_levels", "block_study", "cluster_members", "arrow_anchors", "block_records"])
def test_queries_match_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{small}/lineitem.parquet'")
    got = queries.queries()[name](spark, small)
    want = con.sql(SQL[name]).df()[sorted(got.columns)]
    text = lambda rows: sorted(tuple("-" if pd.isna(v) else f"{float(v):.4f}" for v in r) for r in rows)
    assert text(got.select(*sorted(got.columns)).collect()) == text(want.itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bench_depth(spark, small):
    import bench

    assert bench.BENCH_DEPTH == 8
    n = queries.points(spark, small).count()
    with queries.at_depth(bench.BENCH_DEPTH):
        own = queries.points(spark, small)
        lines = spark.read.parquet(f"{small}/lineitem.parquet")
        assert own.count() == lines.selectExpr(f"floor(l_orderkey / {voxel.ORDERS})", "l_partkey % 256", "(l_suppkey * 7 + l_linenumber * 3) % 256", "CAST(l_quantity AS LONG) % 256").distinct().count() > n
    assert queries.points(spark, small).count() == n


def test_ply_of_several_parts_and_polygons(spark, tmp_path):
    rows = [(i, 2 * i, 3 * i % 7, i % 256, 255 - i % 256, 7) for i in range(3000)]
    own = spark.createDataFrame(rows, "x long, y long, z long, red int, green int, blue int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ply.write_ply(own, str(tmp_path / "parts"), 1023)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r)[1:] for r in ply.read_ply(spark, str(tmp_path / "parts")).collect()) == rows
    text = ["ply", "format ascii 1.0", "element vertex 5", *[f"property float {a}" for a in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "element face 1", "property list uchar int vertex_indices", "end_header"]
    (tmp_path / "8iVFBv2/loot/Ply").mkdir(parents=True)
    (tmp_path / "8iVFBv2/loot/Ply/loot_vox10_1000.ply").write_text("\n".join([*text, *[f"{i} {i} {i} 1 2 3" for i in range(5)], "5 0 1 2 3 4", ""]))
    points, depth = ply.load_frames(spark, "8iVFBv2", "loot", [1], str(tmp_path))
    assert sorted(tuple(r) for r in points.collect()) == [(1, i, i, i, 1, 2, 3) for i in range(5)] and depth == 10


def test_experiments_one_by_one(spark):
    rows = [tuple(r) for r in catalog.experiments(spark).collect()]
    assert len(rows) == len({r[:3] for r in rows}) == 135
    sizes = {r[2]: list(r[3]) for r in rows if r[:2] == ("8iVFBv2", "loot")}
    assert sizes["exp2_b44"] == [2, 2, 2, 2, 2, 4, 4] and sizes["exp2_b444"] == [2, 2, 2, 4, 4, 4] and sizes["exp2_b4444"] == [2, 4, 4, 4, 4]
    depth = {("8iVFBv2",): 10, ("MVUB",): 9}
    for dataset, _, name, bsize, multilevel in rows:
        bits = sum(b.bit_length() - 1 for b in bsize)
        assert bits == (9 if name in ("exp2_b44", "exp2_b444", "exp2_b4444") and dataset == "8iVFBv2" else depth[dataset,]) or not multilevel and len(bsize) == 1


def test_self_loop_of_small_blocks(spark):
    cell = [(0, x, y, z, 10 * x + 5, 20 * y + 5, 30 * z + 5) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    two = [(0, 8, 0, 0, 1, 2, 3), (0, 9, 0, 0, 200, 2, 3)]
    points = voxel.with_yuv(spark.createDataFrame([*cell, *two], "frame_id int, x long, y long, z long, red int, green int, blue int"))
    found = features.selfloop_vertices(points, 8).collect()
    assert [(r["bx"], r["b_y"], r["bz"]) for r in found] == [(0, 0, 0)]


def test_violations(spark):
    rows = [(0, 0, 0, 0, 1, 1, 1), (0, 0, 0, 0, 2, 2, 2), (0, 8, 0, 0, 1, 1, 1), (0, 1, None, 1, 1, 1, 1), (0, 1, 1, 1, None, 1, 1), (1, 7, 7, 7, 1, 1, 1)]
    points = spark.createDataFrame(rows, "frame_id int, x long, y long, z long, red int, green int, blue int")
    assert sorted(map(tuple, voxel.violations(points, 3).collect())) == [(0, 5, 2, 1, 1), (1, 1, 0, 0, 0)]


def test_sweep_of_two_frames(spark, tmp_path):
    from voxloom.plans import sweep

    (tmp_path / "MVUB/phil9/ply").mkdir(parents=True)
    head = ["ply", "format ascii 1.0", "element vertex 30", *[f"property float {a}" for a in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    for frame in (0, 1):
        body = [f"{i} {i // 2} {i // 3 + frame} {8 * i} {255 - i} {3 * i + frame}" for i in range(30)]
        (tmp_path / f"MVUB/phil9/ply/frame{frame:04d}.ply").write_text("\n".join([*head, *body, ""]))
    plan = [("MVUB", "phil9", "exp1_b4", [2] * 7 + [4], True), ("MVUB", "phil9", "exp_zhang_b4", [4], False)]
    rd = sweep.run(spark, plan, [1, 2], str(tmp_path / "rd"), str(tmp_path), (1, 16)).collect()
    assert sorted((r["dataset"], r["sequence"], r["experiment"], r["frame"], r["step"], r["nvox"]) for r in rd) == sorted(("MVUB", "phil9", e, f, s, 30) for e in ("exp1_b4", "exp_zhang_b4") for f in (1, 2) for s in (1, 16))
    assert all(r["seconds"] > 0 and r["bytes"] > 0 for r in rd)
    of = {(r["experiment"], r["frame"], r["step"]): (r["mse"], r["bytes"]) for r in rd}
    assert all(of[e, f, 1][0] < of[e, f, 16][0] and of[e, f, 1][1] > of[e, f, 16][1] for e, f, _ in of)


def test_runs_share_levels(spark):
    from voxloom.plans import shared, sweep

    r = np.random.default_rng(3)
    points = spark.createDataFrame([(int(f), *map(int, p), *map(int, r.integers(0, 256, 3))) for f in (0, 1) for p in np.unique(np.concatenate([r.integers(0, 256, (60, 3)), 100 + r.integers(0, 9, (250, 3))]), axis=0)], "frame_id int, x long, y long, z long, red int, green int, blue int")
    runs = [shared.Run("exp1_b2", (2,) * 8), shared.Run("exp1_b4", (2,) * 6 + (4,)), shared.Run("exp2_b44", (2, 2, 2, 2, 4, 4)), shared.Run("exp_zhang_b8", 8, False), shared.Run("exp4_b4", (2,) * 6 + (4,), graph="gaussian")]
    levels = shared.distinct_levels(runs, 8)
    # Of 8 + 7 + 6 + 1 + 7 levels, the twos on 2/d above the finest fours are those of the first run.
    assert len(levels) == 8 + 1 + 1 + 1 + 7
    own = voxel.with_yuv(points)
    got = shared.run_coefficients(own, runs, 8).cache()
    for number, run in enumerate(runs):
        alone = ragft.forward(own, list(run.bsize) if isinstance(run.bsize, tuple) else run.bsize, 8, run.multilevel, graph=run.graph)
        a, b = (np.array(sorted(map(tuple, x.select(alone.columns).collect())), float) for x in (alone, got.where(f"run = {number}")))
        assert a.shape == b.shape and np.allclose(a[:, :6], b[:, :6]) and np.allclose(np.abs(a[:, 6:]), np.abs(b[:, 6:]), atol=1e-6)
    rd = {(x["experiment"], x["frame"]): x for x in sweep.measure_together(points, runs, 8, (4,)).collect()}
    one = {x["frame"]: x for x in sweep.measure(points, "exp4_b4", [2] * 6 + [4], 8, True, (4,)).collect()}
    assert len(rd) == 10 and all(rd["exp4_b4", f]["bytes"] == one[f]["bytes"] for f in (0, 1)) and rd["exp4_b4", 0]["mse"] != rd["exp1_b4", 0]["mse"]


def test_gaussian_graph_is_found_again(spark):
    r = np.random.default_rng(6)
    own = cloud(spark, np.unique(r.integers(0, 16, (300, 3)), axis=0).tolist())
    coeffs, seen = ragft.observed(ragft.forward(own, [2, 2, 4], 4, graph="gaussian"))
    back = ragft.inverse(coeffs, own, [2, 2, 4], 4, graph="gaussian").join(own, ["x", "y", "z"]).collect()
    assert len(back) == own.count() and max(abs(b["c0"] - b["cy"]) + abs(b["c1"] - b["cu"]) for b in back) < 1e-6
    coeffs.count()
    assert seen.get["n_not_finite"] == seen.get["n_weight"] == seen.get["n_frequency"] == 0


def test_pieces_are_whole_cells():
    import pyarrow as pa

    cells = np.repeat(np.arange(40), np.arange(40) % 7 + 1)
    rows = {"frame_id": np.zeros(len(cells), np.int32), "cell_x": cells, "cell_y": cells * 0, "cell_z": cells * 0, "v": np.arange(len(cells))}
    batches = [pa.RecordBatch.from_pydict({n: c[a : a + 9] for n, c in rows.items()}) for a in range(0, len(cells), 9)]
    for points in (1, 5, 30, 10_000):
        parts = list(ragft._pieces(iter(batches), points))
        assert np.array_equal(np.concatenate([p["v"] for p in parts]), rows["v"])
        assert all(a["cell_x"][-1] != b["cell_x"][0] for a, b in zip(parts, parts[1:]))
        assert len(parts) > 3 or points > 20


def test_stacked_components_match_single_blocks():
    r = np.random.default_rng(9)
    v = np.stack([np.unique(r.integers(0, 8, (40, 3)), axis=0)[:9] for _ in range(60)])
    q = r.integers(1, 5, v.shape[:2]).astype(float)
    rows, freq = spectral.block_basis(v, q)
    for i in range(len(v)):
        one, f = spectral.block_basis(v[i : i + 1], q[i : i + 1])
        assert np.allclose(one[0], rows[i]) and np.allclose(f[0], freq[i])
        assert np.allclose(rows[i] @ rows[i].T, np.eye(9), atol=1e-9) and np.allclose(rows[i, 0], np.sqrt(q[i] / q[i].sum()))


@pytest.mark.parametrize("size", [2, 4, 8, 16, 32, 64])
def test_neighbour_edges_of_any_block_size(spark, size):
    from voxloom.operators import graph

    r = np.random.default_rng(size)
    p = np.unique(r.integers(0, 40, (900, 3)) // [1, 2, 2], axis=0)
    own = cloud(spark, p.tolist())
    y = {tuple(x): c for *x, c in own.select("x", "y", "z", "cy").collect()}
    want = {(*a, *b) for a in y for d in np.ndindex(3, 3, 3) if d != (1, 1, 1) for b in [tuple(int(i + j - 1) for i, j in zip(a, d, strict=True))] if b in y and all(i // size == j // size for i, j in zip(a, b, strict=True))}
    got = graph.neighbour_edges(own, size).collect()
    assert len(got) == len(want) and {tuple(x[c] for c in ("x", "y", "z", "nx", "ny", "nz")) for x in got} == want
    assert all(x["cy"] == y[x["x"], x["y"], x["z"]] and x["n_cy"] == y[x["nx"], x["ny"], x["nz"]] and x["d2"] == abs(x["x"] - x["nx"]) + abs(x["y"] - x["ny"]) + abs(x["z"] - x["nz"]) for x in got)


def test_neighbour_edges_deal_points_once(spark):
    from voxloom.operators import graph

    own = cloud(spark, [[1, 2, 3], [1, 2, 4]])
    plan = graph.degrees(graph.neighbour_edges(own, 8), graph.weight_inverse())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
