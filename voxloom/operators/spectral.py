"""Graph Fourier bases of blocks and the transforms of cells of blocks.

Numpy inside Arrow functions. Blocks of one
size are stacked, so that one call of ``eigh`` serves many. Row order in a block
is (x, y, z); the lowest basis row is set analytically to sqrt(q / sum q), and
every other row has its first entry beyond 1e-9 positive, so that forward and
inverse build the same basis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NEAR = 3.0 + 1e-4  # squared distance sqrt(3), with room for rounding


def neighbour_weights(v: np.ndarray) -> np.ndarray:
    """(B, n, n) weights 2/d between the 26 neighbours of stacked points (B, n, 3)."""
    d2 = ((v[:, :, None, :] - v[:, None, :, :]) ** 2).sum(-1).astype(float)
    near = (d2 > 0) & (d2 <= NEAR)
    return np.where(near, 2.0 / np.sqrt(np.where(near, d2, 1.0)), 0.0)


def gaussian_weights(v: np.ndarray) -> np.ndarray:
    """(B, n, n) exp(-d^2 / 2 s^2) / (degree of i * degree of j) between the 26 neighbours; s^2 = mean(d^2 / 4) / 3 over the edges of the block.

    Geometry alone decides, so the decoder finds the same weights.
    """
    d2 = ((v[:, :, None, :] - v[:, None, :, :]) ** 2).sum(-1).astype(float)
    near = (d2 > 0) & (d2 <= NEAR)
    edges = near.sum((1, 2))
    spread = (np.where(near, d2, 0.0).sum((1, 2)) / np.maximum(edges, 1)) / 12.0
    raw = np.where(near, np.exp(-d2 / (2.0 * np.where(edges > 0, spread, 1.0))[:, None, None]), 0.0)
    degree = raw.sum(2)
    degree = np.where(degree > 0, degree, 1.0)
    return raw / (degree[:, :, None] * degree[:, None, :])


#: Graphs of the transform by name.
GRAPHS = {"inverse": neighbour_weights, "gaussian": gaussian_weights}


def complete_weights(v: np.ndarray) -> np.ndarray:
    """(B, n, n) weights 2/d between all different points; coincident ones are apart."""
    d2 = ((v[:, :, None, :] - v[:, None, :, :]) ** 2).sum(-1)
    return np.where(d2 > 0, 2.0 / np.sqrt(np.where(d2 > 0, d2, 1.0)), 0.0)


def basis(w: np.ndarray, q: np.ndarray, loops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows ascending by frequency, frequencies) of Q^-1/2 L Q^-1/2 for stacked weights and node weights.

    loops: (B, n) added to the diagonal; the lowest row is then that of the eigenvalues, as it is no longer known.
    """
    scale = 1.0 / np.sqrt(q)
    lap = -w.copy()
    n = w.shape[1]
    lap[:, np.arange(n), np.arange(n)] += w.sum(2) + (0.0 if loops is None else loops)
    freq, vec = np.linalg.eigh(lap * scale[:, :, None] * scale[:, None, :])
    rows = np.swapaxes(vec, 1, 2)
    if loops is None:
        dc = np.sqrt(q / q.sum(1, keepdims=True))
        # Where several eigenvalues are zero, the rest of their space is made orthogonal to the lowest row.
        for b in np.flatnonzero(freq[:, 1] < 1e-9) if n > 1 else []:
            null = rows[b, freq[b] < 1e-9]
            rows[b, : len(null)] = _completed(dc[b], null)
        rows[:, 0] = dc
        freq[:, 0] = 0.0
    first = np.argmax(np.abs(rows) > 1e-9, axis=2)
    sign = np.sign(np.take_along_axis(rows, first[:, :, None], 2))
    return rows * np.where(sign == 0, 1.0, sign), np.maximum(freq, 0.0)


def _completed(dc: np.ndarray, null: np.ndarray) -> np.ndarray:
    """dc and an orthonormal basis of the rest of the null space."""
    rest = null - np.outer(null @ dc, dc)
    _, _, axes = np.linalg.svd(rest)
    return np.vstack([dc, axes[: len(null) - 1]])


def labels(w: np.ndarray) -> np.ndarray:
    """(B, n) component of each vertex, named by its least vertex."""
    reach = (w > 0) | np.eye(w.shape[1], dtype=bool)
    for _ in range(max(1, int(np.ceil(np.log2(w.shape[1]))))):
        reach = np.matmul(reach.astype(np.float32), reach.astype(np.float32)) > 0
    return reach.argmax(2)


def block_basis(v: np.ndarray, q: np.ndarray, connected: bool = False, graph: str = "inverse") -> tuple[np.ndarray, np.ndarray]:
    """(B, n, n) orthonormal rows and (B, n) frequencies of stacked blocks, disconnected ones included.

    A disconnected block has a basis for each component; the components' lowest
    rows are transformed once more, on the complete graph of the weighted centroids,
    and come first; the components' other rows follow.
    """
    w = GRAPHS[graph](v)
    rows, freq = np.zeros_like(w), np.zeros(w.shape[:2])
    label = None if connected else labels(w)
    whole = np.ones(len(w), bool) if connected else (label == label[:, :1]).all(1)
    if whole.any():
        rows[whole], freq[whole] = basis(w[whole], q[whole])
    if not whole.all():
        rest = ~whole
        rows[rest], freq[rest] = _parts_basis(v[rest], q[rest], w[rest], label[rest])
    return rows, freq


def _parts_basis(v: np.ndarray, q: np.ndarray, w: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """block_basis of disconnected blocks: components of one size are stacked over all blocks, and so are blocks of one number of components."""
    count, n = label.shape
    rows, low, freq = np.zeros_like(w), np.zeros_like(w), np.zeros((count, n))
    # Points by block and component; components of a block in the order of their least points.
    points = np.argsort((label + np.arange(count)[:, None] * n).ravel(), kind="stable")
    names = (label + np.arange(count)[:, None] * n).ravel()[points]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    size, block = np.diff(np.append(first, len(names))), names[first] // n
    parts = np.bincount(block, minlength=count)
    start = np.cumsum(parts) - parts
    number = np.arange(len(first)) - start[block]
    # The other rows of a component stand after the lowest rows and those of the components before.
    high = parts[block] + np.cumsum(size - 1) - (size - 1) - (np.cumsum(size - 1) - (size - 1))[start[block]]
    total, centre = np.zeros(len(first)), np.zeros((len(first), 3))
    for s in np.unique(size):
        own = np.flatnonzero(size == s)
        at, of = points[first[own][:, None] + np.arange(s)] % n, block[own]
        weight = q[of[:, None], at]
        made, f = basis(w[of[:, None, None], at[:, :, None], at[:, None, :]], weight)
        low[of[:, None], number[own][:, None], at] = made[:, 0]
        if s > 1:
            place = high[own][:, None] + np.arange(s - 1)
            rows[of[:, None, None], place[:, :, None], at[:, None, :]] = made[:, 1:]
            freq[of[:, None], place] = f[:, 1:]
        total[own] = weight.sum(1)
        centre[own] = (v[of[:, None], at] * weight[:, :, None]).sum(1) / total[own][:, None]
    for p in np.unique(parts):
        own = np.flatnonzero(parts == p)
        at = start[own][:, None] + np.arange(p)
        second, f = basis(complete_weights(centre[at]), total[at])
        rows[own, :p], freq[own, :p] = second @ low[own, :p], f
    return rows, freq


def blocks_of(coords: np.ndarray, b: int) -> np.ndarray:
    """Block keys of rows (x, y, z) or (frame, x, y, z)."""
    key = coords.copy()
    key[:, -3:] //= b
    return key


def grouped(coords: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, count): rows sorted by (frame and) block and (x, y, z), and where each block begins."""
    key = blocks_of(coords, b)
    order = np.lexsort((*coords.T[:-4:-1], *key.T[::-1]))
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)]))
    return order, first, np.diff(np.append(first, len(k)))


#: Numbers of a stack of bases: 32 MB.
STACK = 4_000_000


def stacks(first: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the blocks of two points and more, stacked by their number of points in parts of bounded size."""
    for n in np.unique(count[count > 1]):
        at = first[count == n][:, None] + np.arange(n)
        yield from np.array_split(at, len(at) * n * n // STACK + 1)


def forward_level(coords: np.ndarray, q: np.ndarray, a: np.ndarray, b: int, graph: str = "inverse") -> dict[str, np.ndarray]:
    """One level of all blocks of size b: coefficients in block order, k from 0. coords may have a frame before (x, y, z)."""
    order, first, count = grouped(coords, b)
    v, q, a = coords[order], q[order], a[order]
    out, freq, weight = a.astype(float).copy(), np.zeros(len(v)), q.astype(float).copy()
    for part in stacks(first, count):
        rows, f = block_basis(v[part][..., -3:], q[part], b == 2, graph)
        out[part], freq[part] = rows @ a[part], f
        weight[part] = q[part].sum(1, keepdims=True)
    k = np.arange(len(v)) - np.repeat(first, count)
    return {"coords": v, "key": blocks_of(v, b), "k": k, "c": out, "freq": freq, "weight": weight, "first": first, "q": q}


def inverse_level(coords: np.ndarray, q: np.ndarray, c: np.ndarray, b: int, graph: str = "inverse") -> np.ndarray:
    """Attributes of the rows as ``grouped`` orders them, from their blocks' coefficients in that order."""
    order, first, count = grouped(coords, b)
    v, q, out = coords[order], q[order], c.astype(float).copy()
    for part in stacks(first, count):
        rows, _ = block_basis(v[part][..., -3:], q[part], b == 2, graph)
        out[part] = np.swapaxes(rows, 1, 2) @ c[part]
    return out
