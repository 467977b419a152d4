import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import features, ragft, spectral, study, viewdata, voxel
from voxloom.operators.graph import KEYS


@pytest.fixture(scope="module")
def own(spark):
    r = np.random.default_rng(12)
    rows = [(f, *map(int, p), *map(int, r.integers(0, 256, 3))) for f in (0, 2) for p in np.unique(r.integers(0, 16, (260, 3)), axis=0)]
    return voxel.with_yuv(spark.createDataFrame(rows, "frame_id int, x long, y long, z long, red int, green int, blue int")).cache()


@pytest.mark.parametrize("sizes,depth", [([2, 2, 2, 2], 4), ([4, 2, 2], 4), ([2, 4], 4)])
def test_positions_are_those_of_the_sorted_coefficients(spark, own, sizes, depth):
    from voxloom.operators.codec import ordered

    coeffs = ragft.forward(own, sizes[::-1], depth)
    want, count = {}, {}
    for x in ordered(coeffs).coalesce(1).select("frame_id", "level", "bx", "b_y", "bz", "k").collect():
        count[x[0]] = count.get(x[0], 0) + 1
        want[tuple(x)] = count[x[0]]
    got = {tuple(x)[:6]: x["position"] for x in voxel.coefficient_positions(own, sizes, depth).collect()}
    assert got == want


def test_ranges_do_not_matter(own, monkeypatch):
    whole = sorted(map(tuple, voxel.block_boundaries(own, 2, 4).collect()))
    for ranges in (0, 3, 60):
        monkeypatch.setattr(voxel, "RANGES", ranges)
        assert sorted(map(tuple, voxel.block_boundaries(own, 2, 4).collect())) == whole


def test_study_records_hold_bases(own):
    records = study.block_bases(own, 4).collect()
    points = {}
    for p in sorted(own.select("frame_id", "x", "y", "z", "cy").collect()):
        points.setdefault((p[0], p[1] // 4, p[2] // 4, p[3] // 4), []).append(p)
    assert len(records) == 3 * len(points)
    for r in records:
        block = points[tuple(r[k] for k in KEYS)]
        u, f = np.array([x["vector"] for x in r["rows"]]), [x["freq"] for x in r["rows"]]
        y = np.array([p["cy"] for p in block])
        assert np.allclose(u @ u.T, np.eye(len(block)), atol=1e-9) and f == sorted(f)
        assert np.allclose(u @ y, [x["c0"] for x in r["rows"]])
        if r["graph"] < 2:
            v = np.array([p[1:4] for p in block])[None]
            w = spectral.neighbour_weights(v)[0] / (1.0 if r["graph"] == 0 else 1.0 + np.abs(y[:, None] - y) / 256)
            lap = np.diag(w.sum(1)) - w
            assert np.allclose(lap @ u.T, u.T * f, atol=1e-8)
    table = study.point_table(own, study.block_bases(own, 4), 4).collect()
    assert len(table) == own.count() and {tuple(t[c] for c in ("frame_id", "x", "y", "z")) for t in table} == {tuple(p)[:4] for ps in points.values() for p in ps}


def test_directions_that_cancel_have_no_mean_in_any_order(spark):
    steps = [(1, 0, 0), (1, 1, 0), (-1, 1, 1), (0, -1, 1), (1, 1, 1)]
    steps = [np.array(s) / np.sqrt(np.abs(s).sum()) for s in steps]
    r, rows = np.random.default_rng(3), []
    for block in range(40):
        both = [*steps, *(-s for s in steps)]
        if block % 2:
            both.append(np.array([0.0, 0.0, -1.0]))
        for i in r.permutation(len(both)):
            rows.append((0, block, 0, 0, int(i), 0, 0, 0.1, *map(float, both[i])))
        rows.append((0, block, 0, 0, 99, 0, 0, 0.0, 0.0, 0.0, 0.0))
    directed = spark.createDataFrame(rows, "frame_id int, bx long, b_y long, bz long, x long, y long, z long, weight double, ux double, uy double, uz double").coalesce(1)
    got = {x["bx"]: (x["mx"], x["my"], x["mz"]) for x in viewdata.arrows(directed).collect()}
    assert got == {b: (0.0, 0.0, -1.0) if b % 2 else (None, None, None) for b in range(40)}


@pytest.mark.parametrize("query", [lambda b: b, study.first_vectors])
def test_study_deals_points_once_and_no_entries(own, query):
    plan = query(study.block_bases(own, 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("name,exchanges", [("block_study", 2), ("first_vectors", 2)])
def test_study_queries_deal_lines_once_and_sums_once(spark, small, name, exchanges):
    from voxloom import queries

    plan = queries.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == exchanges and "Join" not in plan


def test_looped_points_are_the_vertices_of_the_loops(own):
    got = features.looped_points(own, 4)
    assert sorted(map(tuple, got.where("looped").select(*KEYS, "x", "y", "z").collect())) == sorted(map(tuple, features.selfloop_vertices(own, 4).collect()))
    assert sorted(map(tuple, got.select("frame_id", "x", "y", "z", *voxel.CHANNELS).collect())) == sorted(map(tuple, own.select("frame_id", "x", "y", "z", *voxel.CHANNELS).collect()))


def test_store_joins_without_a_shuffle(spark, own, tmp_path):
    tables = {"records": features.block_records(own, 4), "bases": study.block_bases(own, 4), "metrics": features.block_metrics(own, 4)}
    try:
        for name, table in tables.items():
            study.write_store(table, f"store_{name}", 3, str(tmp_path / name))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both = spark.table("store_records").select(*KEYS, "n").join(spark.table("store_bases").select(*KEYS, "graph", "rows"), list(KEYS)).join(spark.table("store_metrics").select(*KEYS, "m3"), list(KEYS))
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.where("size(rows) = n AND m3 IS NOT NULL").count() == both.count() == 3 * tables["metrics"].count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS store_{name}")


def test_kmeans_puts_blocks_to_the_nearest_mean(own):
    raw = features.normalised(features.block_metrics(own, 4).select(*KEYS, "m1", "m2", "m4"), ["m1", "m2", "m4"])
    rows = features.kmeans_blocks(raw, ["m1", "m2", "m4"]).collect()
    x, cluster = np.array([[r["m1"], r["m2"], r["m4"]] for r in rows]), np.array([r["cluster"] for r in rows])
    means = np.stack([x[cluster == c].mean(0) for c in range(3)])
    near = np.linalg.norm(x[:, None] - means, axis=2)
    # Means are those of the last round but one; only blocks between two clusters may differ.
    assert (near.argmin(1) == cluster).mean() > 0.97
    assert near.min(1).sum() < np.linalg.norm(x - x.mean(0), axis=1).sum()


def test_magnitudes_side_by_side(own):
    from voxloom.operators import viewdata

    plain = own.withColumnsRenamed({"cy": "c0", "cu": "c1", "cv": "c2"})
    a, b = ragft.block_gft(plain, 4), ragft.block_gft(plain, 4, features.selfloop_vertices(own, 4))
    got = viewdata.coeff_magnitudes(a, b)
    assert got.count() == 3 * own.count() and got.where("original < 0 OR modified < 0").count() == 0
    # Both bases are orthonormal: the energy of each channel is that of the points.
    energy = {r["channel"]: (r["a"], r["b"]) for r in got.groupBy("channel").agg(F.sum(F.col("original") ** 2).alias("a"), F.sum(F.col("modified") ** 2).alias("b")).collect()}
    for i, c in enumerate(("cy", "cu", "cv")):
        want = own.agg(F.sum(F.col(c) * F.col(c))).first()[0]
        assert np.allclose(energy[i], want)


def test_many_frames_in_one_scan(spark, tmp_path):
    from voxloom.sources import ply

    paths = {}
    for f in range(12):
        names = ("x", "y", "z", "red", "green", "blue") if f % 2 else ("red", "green", "blue", "z", "y", "x")
        body = [[f, i, 2, 3, 4, 5 + i] for i in range(f + 1)]
        head = ["ply", "format ascii 1.0", *["comment more"] * f, f"element vertex {f + 1}", *[f"property float {n}" for n in names], "end_header"]
        (tmp_path / f"f{f}.ply").write_text("\n".join([*head, *[" ".join(map(str, r)) for r in body], *["3 0 1 2"] * 4, ""]))
        paths[f] = str(tmp_path / f"f{f}.ply")
    own = ply.read_frames(spark, paths)
    want = sorted((f, f, i, 2, 3, 4, 5 + i) if f % 2 else (f, 5 + i, 4, 3, f, i, 2) for f in range(12) for i in range(f + 1))
    assert sorted(map(tuple, own.collect())) == want
    assert own._jdf.queryExecution().toString().count("Union") == 0
    (tmp_path / "bad.ply").write_text("ply\nformat ascii 1.0\n")
    with pytest.raises(Exception, match="end_header"):
        ply.read_frames(spark, {0: paths[0], 1: str(tmp_path / "bad.ply")}).collect()


def test_all_experiments_of_a_sequence_run(spark, tmp_path):
    from voxloom.plans import catalog, shared, sweep

    r = np.random.default_rng(4)
    (tmp_path / "8iVFBv2/loot/Ply").mkdir(parents=True)
    body = [" ".join(map(str, [*p, *r.integers(0, 256, 3)])) for p in np.unique(500 + r.integers(0, 14, (400, 3)), axis=0)]
    head = ["ply", "format ascii 1.0", f"element vertex {len(body)}", *[f"property float {a}" for a in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    (tmp_path / "8iVFBv2/loot/Ply/loot_vox10_1000.ply").write_text("\n".join([*head, *body, ""]))
    plan = [tuple(x) for x in catalog.experiments(spark).where("dataset = '8iVFBv2' AND sequence = 'loot'").collect()]
    rd = sweep.run(spark, plan, [1], str(tmp_path / "rd"), str(tmp_path), (8,)).collect()
    assert {x["experiment"] for x in rd} == {x[2] for x in plan} and len(rd) == len(plan) == 20
    assert all(x["nvox"] == len(body) and x["bytes"] > 0 for x in rd)
    runs = [shared.Run(name, tuple(b) if m else b[0], m, sweep.graph_of(name)) for _, _, name, b, m in plan]
    assert len(shared.distinct_levels(runs, 10)) < sum(len(shared.levels_of(x, 10)) for x in runs) / 2
