import numpy as np
import pytest

from voxloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, ids binary, x long"


def frame(spark, vectors, ids=None):
    rows = [(None if ids and ids[i] is None else (ids or range(len(vectors)))[i], v, 1, "c", None, 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, components=32):
    """(x, S, values falling, whitened) in exact integers and dense linear algebra."""
    x = [[int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:components], vecs[:, ::-1][:, :components]
    return x, s, values, centred @ (vecs / np.sqrt(values)), np.trace(centred.T @ centred) / n


@pytest.mark.parametrize("size,count", [(5, 40), (48, 300)])
def test_whitening_matches_dense_algebra(spark, size, count):
    r = np.random.default_rng(size)
    mix = r.standard_normal((size, size)) * np.linspace(0.1, 2, size)
    good = (r.standard_normal((count, size)) @ mix).astype(np.float32).tolist()
    good += [good[0]] * (count // 3)
    bad = [None, [float("nan")] * size, [None, *good[0][1:]], [float("inf"), *good[0][1:]], [], good[1][:-1]]
    ids = [*range(len(good) - 2), None, 0, *range(9000, 9000 + len(bad))]
    got = whitening.whiten(frame(spark, [*good, *bad], ids), components=32).collect()
    x, s, values, white, trace = brute(good)
    m = min(32, size)
    assert len(got) == len(good) * m and {g["n"] for g in got} == {len(good)}
    deviation = {}
    for i, row in zip(ids, x, strict=False):
        deviation.setdefault(i, set()).add(sum((len(good) * a - b) ** 2 for a, b in zip(row, s, strict=True)))
    assert all(g["deviation"] in deviation[g["vec_id"]] for g in got)
    for c in range(m):
        own = {g["vec_id"]: g["whitened"] for g in got if g["component"] == c + 1 and g["vec_id"] not in (None, 0)}
        a, b = np.array([own[i] for i in ids[1 : len(good) - 2]]), white[1 : len(good) - 2, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    share = {g["component"]: g["explained"] for g in got}
    assert np.allclose([share[c + 1] for c in range(m)], values / trace, rtol=1e-9)
    assert max(g["identity_error"] for g in got) < 1e-9


def test_jacobi_davidson_reaches_double_precision():
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.standard_normal((400, 400)))[0]
    values = np.concatenate([np.linspace(50, 40, 20), [39.0, 39.0, 39.0], np.linspace(30, 0, 377)])
    matrix, calls = (q * values) @ q.T, []
    found, vectors, rounds = whitening.jacobi_davidson(lambda b: (calls.append(b.shape[1]), matrix @ b)[1], 400, 22, restart=104)
    assert np.allclose(found, values[:22], rtol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-10
    assert np.abs(vectors.T @ vectors - np.eye(22)).max() < 1e-12
    assert rounds > 2 and max(calls) <= 104


def test_minres_solves_columns_of_their_own():
    r = np.random.default_rng(4)
    a = r.standard_normal((30, 30))
    a, b = a + a.T, r.standard_normal((30, 3))
    shifts = np.array([0.3, -2.0, 9.0])
    x = whitening.minres(lambda y: a @ y - shifts * y, b, 120, 1e-12)
    assert np.abs(a @ x - shifts * x - b).max() < 1e-6
    assert not whitening.minres(lambda y: y, np.zeros((4, 2)), 5, 1e-9).any()


def test_without_variance_or_rows(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [None, []]):
        assert whitening.whiten(frame(spark, vectors)).count() == 0
    half = whitening.whiten(frame(spark, [[float(i % 7), 3.0] for i in range(50)]))
    assert half.select("component").distinct().count() == 1 and half.count() == 50


def test_sums_in_two_steps(spark, monkeypatch):
    own = frame(spark, np.random.default_rng(1).standard_normal((60, 4)).tolist())
    direct = sorted(map(tuple, whitening.whiten(own).collect()))
    monkeypatch.setattr(whitening, "DIRECT", 1)
    monkeypatch.setattr(whitening, "CHUNK", 16)
    twice = sorted(map(tuple, whitening.whiten(own).collect()))
    assert np.allclose(np.array(direct, float), np.array(twice, float))


def test_large_entries_are_exact(spark):
    got = whitening.whiten(frame(spark, [[1e9, 0.0], [-1e9, 1.0], [5e8, 2.0]])).collect()
    x = [[int(np.floor(64 * v)) + 1_000_000 for v in row] for row in ([1e9, 0.0], [-1e9, 1.0], [5e8, 2.0])]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((3 * a - b) ** 2 for a, b in zip(row, s, strict=True)) for i, row in enumerate(x)}
    assert all(g["deviation"] == (want[g["vec_id"]] if want[g["vec_id"]] < 1 << 63 else None) for g in got)
