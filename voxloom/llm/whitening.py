"""Whitening of embeddings by principal components, found by a block Jacobi-Davidson method.

The covariance is never formed: all that the method asks of the data are products of
the centred covariance with a block of vectors, which Spark makes as sums over packed
chunks of rows, centred before they are multiplied. The driver holds the search space (at most ``restart``
vectors of the embeddings' length) and the small projected matrices. A round
takes the Ritz pairs of the search space (subspace Rayleigh-Ritz), locks those from
the first one on whose residuals have reached the rounding of the product, solves the projected
correction equations of the others together by MINRES (each inner step is one product
of the whole block), and widens the space by the corrections. It ends when all wanted
pairs are locked.

Residuals that stay above the bound for ``max_rounds`` rounds are an error.

Defined results: null vectors and vectors with a null or non-finite entry are
dropped, likewise vectors of another length than most have (the longer, if tied). Entries are
floor(64 c) + 1000000 as long; where that leaves the longs, the row is dropped too. Components
without variance (beyond rounding) cannot be scaled and are left out, so equal vectors, one vector
or no vectors give no rows. Rows are independent otherwise: repeated rows and ids,
and null ids, each count and are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import checkpointed

SCALE, OFFSET = 64.0, 1_000_000
#: Numbers of a chunk (8 bytes each), and of a batch of result rows.
CHUNK, BATCH = 1 << 17, 1 << 19


@dataclass
class Model:
    """n rows, sums per dimension, values (falling) and vectors (a column each) of the covariance, and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    rounds: int = 0


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ids, known, rows, x): chunks of the rows that can be used, their entries and ids packed as 64-bit integers; known: which ids are not null."""
    given = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # The bound keeps floor(64 c) + 1000000 inside the longs.
    good = given.where(F.expr("v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) <= 1e17D)"))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 1
    good = good.where(F.size("v") == d)
    step = max(1, CHUNK // d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                c = part.column("v").flatten().to_numpy(zero_copy_only=False)
                x = np.floor(SCALE * c).astype(np.int64) + OFFSET
                ids = part.column("id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pylist([{"ids": ids.fill_null(0).to_numpy().tobytes(), "known": known.tobytes(), "rows": part.num_rows, "x": x.tobytes()}], pa.schema([("ids", pa.binary()), ("known", pa.binary()), ("rows", pa.int32()), ("x", pa.binary())]))

    return good.mapInArrow(run, "ids binary, known binary, rows int, x binary")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for rows, x in zip(batch.column("rows").to_pylist(), batch.column("x"), strict=True):
            yield np.frombuffer(x.as_buffer(), np.int64).reshape(rows, -1)


#: Partitions whose blocks the driver sums itself.
DIRECT = 64


def _reduced(chunks: DataFrame, make: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> np.ndarray | float:
    """The sum over all partitions of what make finds in each, a block of a fixed size; beyond DIRECT partitions, tasks sum blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = make(_chunks(batches))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(out, np.float64).tobytes()], pa.binary())], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in batch.column(0):
                one = np.frombuffer(s.as_buffer(), np.float64)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = chunks.select("rows", "x").mapInArrow(run, "s binary")
    if chunks.rdd.getNumPartitions() > DIRECT:
        parts = parts.repartition(DIRECT).mapInArrow(add, "s binary")
    return sum(np.frombuffer(r["s"], np.float64) for r in parts.collect())


def totals(chunks: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sums of each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, None, None
        for x in _chunks(batches):
            # Halves of 32 bits, so that no sum of a partition leaves the longs.
            a, b = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
            n, low, high = n + len(x), a if low is None else low + a, b if high is None else high + b
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(low)), pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], ["n", "i", "low", "high"])

    parts = chunks.select("rows", "x").mapInArrow(run, "n long, i long, low long, high long")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high")).orderBy("i").collect()
    return (int(rows[0]["n"]), [int(r["high"]) * (1 << 32) + int(r["low"]) for r in rows]) if rows else (0, [])


def _centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The means as whole numbers and the rest, so that rows are centred without loss."""
    whole = np.array([s // n for s in sums], np.int64)
    return whole, np.array([(s % n) / n for s in sums])


def covariance_product(chunks: DataFrame, n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """A function that multiplies the centred covariance with a block of vectors (a column each): one job a call."""
    whole, rest = _centre(sums, n)

    def product(block: np.ndarray) -> np.ndarray:
        def run(parts: Iterator[np.ndarray]) -> np.ndarray | None:
            total = None
            for x in parts:
                c = (x - whole).astype(np.float64) - rest
                one = c.T @ (c @ block)
                total = one if total is None else total + one
            return total

        return np.reshape(_reduced(chunks, run), block.shape) / n

    return product


def trace_of(chunks: DataFrame, n: int, sums: list[int]) -> float:
    whole, rest = _centre(sums, n)

    def run(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        return np.array([sum(float(np.square((x - whole).astype(np.float64) - rest).sum()) for x in parts)])

    return float(_reduced(chunks, run)[0]) / n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to an orthonormal basis; directions lost to rounding go."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    block = u[:, s > 1e-8]
    block = block - against @ (against.T @ block)
    return np.linalg.qr(block)[0] if block.shape[1] else block


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of one symmetric system a column, all with one call of apply a step.

    apply multiplies column j with the j-th matrix. A column stops when its residual
    has fallen by the tolerance; the others go on.
    """
    x, v_before = np.zeros_like(b), np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v, eta = b / start, beta.copy()
    c_before, c, s_before, s = (np.ones(b.shape[1]), np.ones(b.shape[1]), np.zeros(b.shape[1]), np.zeros(b.shape[1]))
    w_before, w = np.zeros_like(b), np.zeros_like(b)
    last, live = np.zeros(b.shape[1]), beta > 0
    for _ in range(steps):
        if not live.any():
            break
        y = apply(v)
        alpha = (v * y).sum(0)
        y = y - alpha * v - last * v_before
        beta = np.linalg.norm(y, axis=0)
        # The new column of the tridiagonal matrix, turned by the last two rotations.
        delta, rho2, rho3 = c * alpha - c_before * s * last, s * alpha + c_before * c * last, s_before * last
        rho1 = np.sqrt(delta * delta + beta * beta)
        safe = np.where(rho1 > 0, rho1, 1.0)
        c_before, s_before, c, s = c, s, delta / safe, beta / safe
        w_before, w = w, (v - rho3 * w_before - rho2 * w) / safe
        x = np.where(live, x + c * eta * w, x)
        eta = -s * eta
        live = live & (np.abs(eta) > tolerance * start) & (beta > 1e-14 * np.abs(alpha)) & (rho1 > 0)
        v_before, v, last = v, y / np.where(beta > 0, beta, 1.0), beta
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, *, restart: int | None = None, inner: int = 6, max_rounds: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(values falling, unit vectors, rounds) of the ``wanted`` largest eigenvalues of a symmetric positive operator.

    restart: columns of the search space beyond which it is cut back to its best Ritz vectors.
    """
    block = min(size, wanted + 4)
    restart = min(size, restart or 4 * block)
    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, block)))[0]
    image = product(space)
    for turn in range(1, max_rounds + 1):
        small = space.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz = space @ turns[:, :block]
        residual = image @ turns[:, :block] - ritz * values[:block]
        bound = 64 * np.finfo(float).eps * size**0.5 * max(values[0], np.finfo(float).tiny)
        locked = np.linalg.norm(residual[:, :wanted], axis=0) <= bound
        # With the whole space searched, what is left of the residuals is the rounding of the products.
        if locked.all() or space.shape[1] == size:
            return values[:wanted], ritz[:, :wanted], turn
        open_ = np.flatnonzero(np.concatenate([~locked, np.ones(block - wanted, bool)]))
        theta, kept = values[open_], ritz[:, :wanted]
        away = lambda y: y - kept @ (kept.T @ y)
        shifted = lambda y: away(product(away(y)) - theta * away(y))
        more = _orthonormal(minres(shifted, -away(residual[:, open_]), inner, 1e-3), space)
        if space.shape[1] + more.shape[1] > restart and restart < size:
            space = np.linalg.qr(space @ turns[:, : restart - more.shape[1]])[0]
            image, more = product(space), _orthonormal(more, space)
        if not more.shape[1]:
            more = _orthonormal(np.random.default_rng(turn).standard_normal((size, 1)), space)
        more = more[:, : restart - space.shape[1]]
        space, image = np.hstack([space, more]), np.hstack([image, product(more)])
    raise RuntimeError(f"not all residuals are small after {max_rounds} rounds")


def fit(chunks: DataFrame, components: int = 32) -> Model | None:
    """The principal components of all chunks; None where there are no rows."""
    n, sums = totals(chunks)
    if not n:
        return None
    trace = trace_of(chunks, n, sums)
    if trace == 0.0:
        return Model(n, sums, np.empty(0), np.empty((len(sums), 0)), 0.0)
    values, vectors, rounds = jacobi_davidson(covariance_product(chunks, n, sums), len(sums), min(components, len(sums)))
    real = values > 64 * np.finfo(float).eps * len(sums) * values[0]
    values, vectors = values[real], vectors[:, real]
    # Of the two signs, the one that makes the largest entry positive.
    top = np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)
    return Model(n, sums, values, vectors * np.sign(top), trace, rounds)


def identity_error(chunks: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    (whole, rest), scaled, m = _centre(model.sums, model.n), model.vectors / np.sqrt(model.values), len(model.values)

    def run(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        total = np.zeros((m + 1, m))
        for x in parts:
            y = ((x - whole).astype(np.float64) - rest) @ scaled
            total += np.vstack([y.T @ y, y.sum(0)])
        return total

    total = np.reshape(_reduced(chunks, run), (m + 1, m)) / model.n
    return float(np.abs(total[:m] - np.outer(total[m], total[m]) - np.eye(m)).max())


def _deviations(t: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows; None beyond the longs."""
    if not t.size or int(np.abs(t).max()) ** 2 * t.shape[1] < 1 << 63:
        return np.square(t).sum(1).tolist()
    each = [sum(int(v) ** 2 for v in row) for row in t]
    return [v if v < 1 << 63 else None for v in each]


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    deviation: sum over the dimensions of (n x - S)^2, S the sum over all rows; null beyond the longs.
    """
    chunks = checkpointed(integers(vectors, key, vector))
    model = fit(chunks, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], WHITENED)
    error = identity_error(chunks, model)
    (whole, rest), n, m = _centre(model.sums, model.n), model.n, len(model.values)
    left = [s % n for s in model.sums]
    scaled, shares = model.vectors / np.sqrt(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, rows, packed in zip(*(batch.column(c) for c in ("ids", "known", "rows", "x")), strict=True):
                x = np.frombuffer(packed.as_buffer(), np.int64).reshape(rows.as_py(), -1)
                ids = pa.array(np.frombuffer(ids.as_buffer(), np.int64), mask=~np.frombuffer(known.as_buffer(), bool))
                step = max(1, BATCH // m)
                for at in range(0, len(x), step):
                    d = x[at : at + step] - whole
                    wide = int(np.abs(d).max()) * n >= 1 << 62
                    t = (d.astype(object) if wide else d) * n - np.array(left, object if wide else np.int64)
                    y, k = (d.astype(np.float64) - rest) @ scaled, len(d)
                    columns = [
                        ids.slice(at, k).take(pa.array(np.repeat(np.arange(k), m))),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                        pa.array(np.full(k * m, n, np.int64)),
                        pa.array(_deviations(t), pa.int64()).take(pa.array(np.repeat(np.arange(k), m))),
                        pa.array(y.ravel()),
                        pa.array(np.tile(shares, k)),
                        pa.array(np.full(k * m, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in WHITENED.split(", ")])

    return chunks.mapInArrow(run, WHITENED)
