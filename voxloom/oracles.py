"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from voxloom.functions.color import TO_YUV
from voxloom.operators.voxel import ORDERS
from voxloom.queries import CENTROIDS, DEPTH, FINEST, STEPS

_N = 1 << DEPTH
_YUV = ", ".join(
    f"255e0 * least(greatest(red / 255e0 * {TO_YUV[0][i]!r}::DOUBLE + green / 255e0 * ({TO_YUV[1][i]!r})::DOUBLE + blue / 255e0 * ({TO_YUV[2][i]!r})::DOUBLE + {TO_YUV[3][i]!r}::DOUBLE, 0e0), 1e0) AS {n}".replace(f"{TO_YUV[0][i]!r}::DOUBLE", f"({TO_YUV[0][i]!r})::DOUBLE")
    for i, n in enumerate(("cy", "cu", "cv"))
)
_BASE = f"""pts AS (
  SELECT CAST(l_orderkey // {ORDERS} AS INTEGER) AS frame_id, l_partkey % {_N} AS x, (l_suppkey * 7 + l_linenumber * 3) % {_N} AS y, CAST(l_quantity AS BIGINT) % {_N} AS z,
    CAST(min((l_orderkey * 37) % 256) AS INTEGER) AS red, CAST(min((l_partkey * 11) % 256) AS INTEGER) AS green, CAST(min((l_suppkey * 53) % 256) AS INTEGER) AS blue
  FROM lineitem GROUP BY 1, 2, 3, 4
), cloud AS (SELECT frame_id, x, y, z, red, green, blue, {_YUV} FROM pts)"""


def _edges(size: int) -> str:
    """Edges inside blocks, from the grid of offsets."""
    return f"""own AS (SELECT *, x // {size} AS bx, y // {size} AS b_y, z // {size} AS bz FROM cloud),
offsets AS (SELECT a.v AS dx, b.v AS dy, c.v AS dz FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v), (VALUES (-1), (0), (1)) c(v) WHERE NOT (a.v = 0 AND b.v = 0 AND c.v = 0)),
sent AS (SELECT own.*, x + dx AS tx, y + dy AS ty, z + dz AS tz, abs(dx) + abs(dy) + abs(dz) AS d2 FROM own, offsets),
edges AS (
  SELECT s.frame_id, s.bx, s.b_y, s.bz, s.x, s.y, s.z, t.x AS nx, t.y AS ny, t.z AS nz, CAST(s.d2 AS INTEGER) AS d2, s.cy, t.cy AS n_cy
  FROM sent s JOIN own t ON t.frame_id = s.frame_id AND t.x = s.tx AND t.y = s.ty AND t.z = s.tz AND t.bx = s.bx AND t.b_y = s.b_y AND t.bz = s.bz
)"""


def _q(body: str, *, edges: int = 0, more: str = "", recursive: bool = False) -> str:
    parts = [_BASE, *([_edges(edges)] if edges else []), *([more] if more else [])]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def _r4(x: str, name: str) -> str:
    return f"round({x}, 4) + 0e0 AS {name}"


_LEVELS = " UNION ALL ".join(f"SELECT CAST({DEPTH - i} AS INTEGER) AS level, frame_id, x // {2 ** (i + 1)} AS x, y // {2 ** (i + 1)} AS y, z // {2 ** (i + 1)} AS z, count(*) AS q, sum(cy) / sqrt(count(*)) AS cy, sum(cu) / sqrt(count(*)) AS cu, sum(cv) / sqrt(count(*)) AS cv FROM cloud GROUP BY 2, 3, 4, 5" for i in range(DEPTH))
_PYRAMID = f"pyramid AS ({_LEVELS})"
_METRICS = """grads AS (SELECT frame_id, bx, b_y, bz, abs(n_cy - cy) / 256e0 AS g FROM edges),
gm AS (SELECT frame_id, bx, b_y, bz, avg(g) AS m1, CASE WHEN count(*) = 1 THEN 0e0 ELSE stddev_samp(g) END AS m2 FROM grads WHERE g <> 0 GROUP BY ALL),
pm AS (SELECT frame_id, bx, b_y, bz, count(*) AS n, avg(cy) AS m3, CASE WHEN count(*) = 1 THEN 0e0 ELSE stddev_samp(cy) END AS m4 FROM own GROUP BY ALL),
metrics AS (SELECT pm.frame_id, pm.bx, pm.b_y, pm.bz, n, m1, m2, m3, m4 FROM pm LEFT JOIN gm ON pm.frame_id = gm.frame_id AND pm.bx = gm.bx AND pm.b_y = gm.b_y AND pm.bz = gm.bz)"""
_FEATURES = _METRICS + """, known AS (SELECT * FROM metrics WHERE m1 IS NOT NULL AND m2 IS NOT NULL),
norms AS (SELECT sqrt(sum(m1 * m1)) AS n1, sqrt(sum(m2 * m2)) AS n2, sqrt(sum(m4 * m4)) AS n4 FROM known),
feats AS (SELECT frame_id, bx, b_y, bz, m1 / n1 AS m1, m2 / n2 AS m2, m4 / n4 AS m4 FROM known, norms)"""
_DISTS = _FEATURES + ", dists AS (" + " UNION ALL ".join(f"SELECT frame_id, bx, b_y, bz, {i} AS cluster, round(sqrt((m1 - {a}) * (m1 - {a}) + (m2 - {b}) * (m2 - {b}) + (m4 - {c}) * (m4 - {c})), 9) AS distance FROM feats" for i, (a, b, c) in enumerate(CENTROIDS)) + ")"
_NEAREST = _DISTS + ", nearest AS (SELECT frame_id, bx, b_y, bz, min(struct_pack(d := distance, c := cluster)) AS best FROM dists GROUP BY ALL)"
_DIRECTED = """jumps AS (SELECT frame_id, bx, b_y, bz, x, y, z, min(struct_pack(g := floor((cy - n_cy) / 256e0 * 1e6 + 0.5e0) / 1e6, nx := nx, ny := ny, nz := nz, d2 := d2)) AS s FROM edges GROUP BY ALL),
directed AS (
  SELECT o.frame_id, o.bx, o.b_y, o.bz, o.x, o.y, o.z, coalesce(abs(j.s.g), 0e0) AS weight,
    coalesce((o.x - j.s.nx) / sqrt(j.s.d2), 0e0) AS ux, coalesce((o.y - j.s.ny) / sqrt(j.s.d2), 0e0) AS uy, coalesce((o.z - j.s.nz) / sqrt(j.s.d2), 0e0) AS uz
  FROM own o LEFT JOIN (SELECT * FROM jumps WHERE s.g < -0.02e0) j ON o.frame_id = j.frame_id AND o.x = j.x AND o.y = j.y AND o.z = j.z
), sums AS (
  SELECT frame_id, bx, b_y, bz, CASE WHEN sum(weight) <> 0 THEN sum(weight * ux) / sum(weight) END AS sx, CASE WHEN sum(weight) <> 0 THEN sum(weight * uy) / sum(weight) END AS sy, CASE WHEN sum(weight) <> 0 THEN sum(weight * uz) / sum(weight) END AS sz
  FROM directed GROUP BY ALL
), means AS (
  SELECT frame_id, bx, b_y, bz, CASE WHEN n > 0 THEN sx / n END AS mx, CASE WHEN n > 0 THEN sy / n END AS my, CASE WHEN n > 0 THEN sz / n END AS mz
  FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS n FROM sums)
)"""
_LOOPS = _DIRECTED + """, deg AS (SELECT frame_id, x, y, z, sum(1e0 / sqrt(d2)) AS degree FROM edges GROUP BY ALL),
ranked AS (
  SELECT o.frame_id, o.bx, o.b_y, o.bz, o.x, o.y, o.z, row_number() OVER (PARTITION BY o.frame_id, o.bx, o.b_y, o.bz ORDER BY round(coalesce(degree, 0e0), 6), o.x, o.y, o.z) AS pos, count(*) OVER b AS n,
    avg(o.x) OVER b AS gx, avg(o.y) OVER b AS gy, avg(o.z) OVER b AS gz
  FROM own o LEFT JOIN deg d ON o.frame_id = d.frame_id AND o.x = d.x AND o.y = d.y AND o.z = d.z WINDOW b AS (PARTITION BY o.frame_id, o.bx, o.b_y, o.bz)
), loops AS (
  SELECT r.frame_id, r.bx, r.b_y, r.bz, min(struct_pack(dot := coalesce(round((x - gx) * mx + (y - gy) * my + (z - gz) * mz, 6), 0e0), pos := pos, x := x, y := y, z := z)) AS s
  FROM ranked r JOIN means m ON r.frame_id = m.frame_id AND r.bx = m.bx AND r.b_y = m.b_y AND r.bz = m.bz WHERE pos <= round(0.2e0 * n) GROUP BY ALL
)"""
_COMPONENTS = """numbered AS (SELECT *, ((x - bx * 4) * 4 + (y - b_y * 4)) * 4 + (z - bz * 4) AS code FROM own),
reach AS (SELECT frame_id, x, y, z, code FROM numbered UNION SELECT e.frame_id, e.nx, e.ny, e.nz, r.code FROM reach r JOIN edges e ON e.frame_id = r.frame_id AND e.x = r.x AND e.y = r.y AND e.z = r.z),
labelled AS (SELECT frame_id, x, y, z, x // 4 AS bx, y // 4 AS b_y, z // 4 AS bz, min(code) AS component FROM reach GROUP BY frame_id, x, y, z),
centroids AS (SELECT frame_id, bx, b_y, bz, component, count(*) AS n, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz FROM labelled GROUP BY frame_id, bx, b_y, bz, component)"""
_RECORDS = f"""{_METRICS}, {_LOOPS},
placed AS (SELECT frame_id, bx, b_y, bz, x, y, z, row_number() OVER (PARTITION BY frame_id, bx, b_y, bz ORDER BY x, y, z) - 1 AS place FROM own),
sent_from AS MATERIALIZED (SELECT e.*, p.place FROM edges e JOIN placed p ON e.frame_id = p.frame_id AND e.x = p.x AND e.y = p.y AND e.z = p.z),
links AS (
  SELECT e.frame_id, e.bx, e.b_y, e.bz, count(*) AS n_edges, sum(2e0 / sqrt(d2)) AS degree_sum, CAST(sum((p.place - e.place) * (p.place - e.place)) AS BIGINT) AS reach
  FROM sent_from e JOIN placed p ON e.frame_id = p.frame_id AND e.nx = p.x AND e.ny = p.y AND e.nz = p.z GROUP BY ALL
), looped AS (SELECT p.* FROM loops l JOIN placed p ON l.frame_id = p.frame_id AND l.s.x = p.x AND l.s.y = p.y AND l.s.z = p.z)"""
_PAIR = "frame_id, x, y, z, nx, ny, nz"
_CELLS = ", ".join(f"cells{i} AS (SELECT frame_id, x // {2**i} AS x, y // {2**i} AS y, z // {2**i} AS z, count(*) AS q, {', '.join(f'sum({c}) / sqrt(count(*)) AS {c}' for c in ('cy', 'cu', 'cv'))} FROM cloud GROUP BY 1, 2, 3, 4)" for i in range(DEPTH + 1))


def _morton(bits: int) -> str:
    return " + ".join(f"((({v} >> {i}) & 1) << {3 * i + k})" for i in range(bits) for k, v in enumerate(("bz", "b_y", "bx"))) or "0"


_BLOCKS = ", ".join(f"blocks{i} AS (SELECT frame_id, x // 2 AS bx, y // 2 AS b_y, z // 2 AS bz, count(*) AS n, {', '.join(f'sum({c} * {c}) AS e{j}, sum(sqrt(q) * {c}) / sqrt(sum(q)) AS d{j}' for j, c in enumerate(('cy', 'cu', 'cv')))} FROM cells{i} GROUP BY 1, 2, 3, 4)" for i in range(DEPTH))
_COUNTS = "counts AS (" + " UNION ALL ".join(
    [f"SELECT frame_id, 1 AS level, 0 AS grp, bx, b_y, bz, {_morton(0)} AS m, 0 AS k, 1 AS n FROM blocks{DEPTH - 1}"]
    + [f"SELECT frame_id, {DEPTH - i} AS level, {DEPTH - i} AS grp, bx, b_y, bz, {_morton(DEPTH - 1 - i)} AS m, 1 AS k, n - 1 AS n FROM blocks{i} WHERE n > 1" for i in range(DEPTH)]
) + ")"
# All cells of a block of edge 2 are neighbours: the trace of Q^-1/2 L Q^-1/2 is the sum over ordered pairs of 2 / (d q).
_TRACES = "traces AS (" + " UNION ALL ".join(f"SELECT a.frame_id, {DEPTH - i} AS level, sum(2e0 / sqrt(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)) / a.q) AS trace FROM cells{i} a JOIN cells{i} b ON a.frame_id = b.frame_id AND a.x // 2 = b.x // 2 AND a.y // 2 = b.y // 2 AND a.z // 2 = b.z // 2 WHERE NOT (a.x = b.x AND a.y = b.y AND a.z = b.z) GROUP BY 1" for i in range(DEPTH)) + ")"
_ENERGIES = "energies AS (" + " UNION ALL ".join(f"SELECT frame_id, {DEPTH - i} AS level, sum(n - {0 if i == DEPTH - 1 else 1}) AS n, {', '.join(f'sum(e{j} - d{j} * d{j}) AS energy{j}' for j in range(3))} FROM blocks{i} GROUP BY 1" for i in range(DEPTH)) + ")"


def _runs() -> str:
    """Coefficients and energy of each level of each run: what its cells have beyond what its blocks keep as lowest coefficients."""
    out = []
    for run, finest in enumerate(FINEST):
        bits = [b.bit_length() - 1 for b in reversed(finest)]
        bits += [1] * (DEPTH - sum(bits))
        for i, b in enumerate(bits):
            low, high = sum(bits[:i]), sum(bits[: i + 1])
            energy = ", ".join(f"round(a.e{j} - b.e{j}, 1) AS energy{j}" for j in range(3))
            out.append(f"SELECT CAST({run} AS INTEGER) AS run, a.frame_id, CAST({len(bits) - i} AS INTEGER) AS level, a.n - {'0' if high == DEPTH else 'b.n'} AS n, {energy} FROM sums a JOIN sums b ON a.frame_id = b.frame_id WHERE a.i = {low} AND b.i = {high}")
    return " UNION ALL ".join(out)


_SUMS = "sums AS (" + " UNION ALL ".join(f"SELECT {i} AS i, frame_id, count(*) AS n, {', '.join(f'sum({c} * {c}) AS e{j}' for j, c in enumerate(('cy', 'cu', 'cv')))} FROM cells{i} GROUP BY 2" for i in range(DEPTH + 1)) + ")"


def oracle_sql() -> dict[str, str]:
    energy = ", ".join(f"{_r4(f'sum({c}) / sqrt(count(*))', f'dc{i}')}, round(sum({c} * {c}), 2) AS energy{i}" for i, c in enumerate(("cy", "cu", "cv")))
    yuv = ", ".join(_r4(c, c) for c in ("cy", "cu", "cv"))
    block8 = "frame_id, x // 8 AS bx, y // 8 AS b_y, z // 8 AS bz"
    means = ", ".join(_r4(c, c) for c in ("mx", "my", "mz"))
    dev = "exp(-d2 / 2e0 - ((n_cy - cy) / 256e0) * ((n_cy - cy) / 256e0) / (2e0 * 0.1e0 * 0.1e0))"
    morton = _morton(DEPTH - 3)
    own = "o.frame_id = {0}.frame_id AND o.x = {0}.x AND o.y = {0}.y AND o.z = {0}.z"
    return {
        "coefficient_order": _q("SELECT frame_id, CAST(level AS INTEGER) AS level, bx, b_y, bz, CAST(k + i AS INTEGER) AS k, CAST(before + i + 1 AS BIGINT) AS position FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY grp, m) - n AS before FROM counts))", more=f"{_CELLS}, {_BLOCKS}, {_COUNTS}"),
        "ragft_levels": _q("SELECT e.frame_id, CAST(e.level AS INTEGER) AS level, CAST(e.n AS BIGINT) AS n, round(energy0, 1) AS energy0, round(energy1, 1) AS energy1, round(energy2, 1) AS energy2, round(coalesce(trace, 0e0), 2) AS trace FROM energies e LEFT JOIN traces t ON e.frame_id = t.frame_id AND e.level = t.level WHERE e.n > 0", more=f"{_CELLS}, {_BLOCKS}, {_ENERGIES}, {_TRACES}"),
        "shared_runs": _q(f"SELECT * FROM ({_runs()}) WHERE n > 0", more=f"{_CELLS}, {_SUMS}"),
        "block_study": _q(
            f"SELECT o.frame_id, o.bx, o.b_y, o.bz, count(*) AS n, round(sum(coalesce(p, 0e0)), 3) AS trace_plain, round(sum(coalesce(l, 0e0)), 3) AS trace_luma, round(sum(coalesce(p, 0e0)) + max(CASE WHEN s.s IS NULL THEN 0e0 ELSE 2e0 END), 3) AS trace_loop, {', '.join(f'round(sum(o.cy * o.cy), 1) AS energy_{g}' for g in ('plain', 'luma', 'loop'))} FROM own o LEFT JOIN degs g ON {own.format('g')} LEFT JOIN loops s ON s.frame_id = o.frame_id AND s.bx = o.bx AND s.b_y = o.b_y AND s.bz = o.bz GROUP BY 1, 2, 3, 4",
            edges=4, more=_LOOPS + ", degs AS (SELECT frame_id, x, y, z, sum(2e0 / sqrt(d2)) AS p, sum(2e0 / (sqrt(d2) * (1e0 + abs(n_cy - cy) / 256e0))) AS l FROM edges GROUP BY ALL)",
        ),
        "first_vectors": _q("SELECT frame_id, x // 4 AS bx, y // 4 AS b_y, z // 4 AS bz, CAST(g AS INTEGER) AS graph, count(*) AS n, 1e0 AS length FROM pts, (VALUES (0), (1), (2)) v(g) GROUP BY 1, 2, 3, 4, 5"),
        "cluster_members": _q(f"SELECT best.c AS cluster, m.frame_id, m.bx, m.b_y, m.bz, n, {', '.join(_r4(f'm.{m}', m) for m in ('m1', 'm2', 'm3', 'm4'))} FROM metrics m JOIN nearest b ON m.frame_id = b.frame_id AND m.bx = b.bx AND m.b_y = b.b_y AND m.bz = b.bz", edges=8, more=_NEAREST),
        "arrow_anchors": _q(
            f"SELECT r.frame_id, r.bx, r.b_y, r.bz, {', '.join(f'CASE WHEN m{a} < 0 THEN high_{a} ELSE low_{a} END AS a{a}' for a in 'xyz')}, {', '.join(_r4(f'm{a} * (high_{a} - low_{a} - 1)', f'm{a}') for a in 'xyz')} FROM reach r JOIN (SELECT frame_id, bx, b_y, bz, {', '.join(_r4(f'm{a}', f'm{a}') for a in 'xyz')} FROM means WHERE mx IS NOT NULL) m ON r.frame_id = m.frame_id AND r.bx = m.bx AND r.b_y = m.b_y AND r.bz = m.bz",
            edges=8, more=_DIRECTED + ", reach AS (SELECT frame_id, bx, b_y, bz, " + ", ".join(f"min({a}) AS low_{a}, max({a}) AS high_{a}" for a in "xyz") + " FROM own GROUP BY ALL)",
        ),
        "rgb_to_yuv": _q(f"SELECT frame_id, x, y, z, {yuv} FROM cloud"),
        "yuv_roundtrip": _q("SELECT frame_id, x, y, z, red, green, blue FROM pts"),
        "voxel_blocks": _q("SELECT frame_id, x // 4 AS bx, y // 4 AS b_y, z // 4 AS bz, count(*) AS n FROM pts GROUP BY 1, 2, 3, 4"),
        "block_boundaries": _q(f"SELECT frame_id, bx, b_y, bz, start_row, start_row + n - 1 AS end_row FROM (SELECT frame_id, bx, b_y, bz, n, CAST(sum(n) OVER (PARTITION BY frame_id ORDER BY {morton}) - n + 1 AS BIGINT) AS start_row FROM (SELECT {block8}, count(*) AS n FROM pts GROUP BY 1, 2, 3, 4))"),
        "q_pyramid": _q("SELECT level, frame_id, x, y, z, q FROM pyramid", more=_PYRAMID),
        "dc_pyramid": _q(f"SELECT level, frame_id, x, y, z, q, {yuv} FROM pyramid", more=_PYRAMID),
        "neighbor_edges": _q(f"SELECT {_PAIR}, d2 FROM edges", edges=8),
        "edge_weights_luma": _q(f"SELECT {_PAIR}, {_r4('2e0 / (sqrt(d2) * (1e0 + abs(n_cy - cy) / 256e0))', 'w')} FROM edges", edges=8),
        "edge_weights_bilateral": _q(f"SELECT {_PAIR}, {_r4(dev, 'w')} FROM edges", edges=8),
        "gaussian_weights": _q(
            f"SELECT r.frame_id, r.x, r.y, r.z, r.nx, r.ny, r.nz, {_r4('r.w / (a.deg * b.deg)', 'w')} FROM raw r JOIN deg a ON a.frame_id = r.frame_id AND a.x = r.x AND a.y = r.y AND a.z = r.z JOIN deg b ON b.frame_id = r.frame_id AND b.x = r.nx AND b.y = r.ny AND b.z = r.nz",
            edges=8,
            more="spread AS (SELECT frame_id, bx, b_y, bz, avg(d2 / 4e0) / 3e0 AS s2 FROM edges GROUP BY ALL), raw AS (SELECT e.*, exp(-d2 / (2e0 * s2)) AS w FROM edges e JOIN spread s ON e.frame_id = s.frame_id AND e.bx = s.bx AND e.b_y = s.b_y AND e.bz = s.bz), deg AS (SELECT frame_id, x, y, z, sum(w) AS deg FROM raw GROUP BY ALL)",
        ),
        "vertex_degree": _q(f"SELECT frame_id, x, y, z, {_r4('sum(2e0 / sqrt(d2))', 'degree')} FROM edges GROUP BY frame_id, x, y, z", edges=8),
        "laplacian_triples": _q(f"SELECT {_PAIR}, {_r4('-2e0 / sqrt(d2)', 'l')} FROM edges UNION ALL SELECT frame_id, x, y, z, x, y, z, {_r4('sum(2e0 / sqrt(d2))', 'l')} FROM edges GROUP BY frame_id, x, y, z", edges=8),
        "selfloop_laplacian": _q(f"SELECT frame_id, bx, b_y, bz, {_r4('sum(l)', 'trace')} FROM (SELECT frame_id, bx, b_y, bz, 2e0 / sqrt(d2) AS l FROM edges UNION ALL SELECT frame_id, bx, b_y, bz, 2e0 FROM loops) GROUP BY frame_id, bx, b_y, bz", edges=8, more=_LOOPS),
        "block_metrics": _q(f"SELECT frame_id, bx, b_y, bz, n, {', '.join(_r4(m, m) for m in ('m1', 'm2', 'm3', 'm4'))} FROM metrics", edges=8, more=_METRICS),
        "gradient_direction": _q(f"SELECT frame_id, x, y, z, weight, {', '.join(_r4(c, c) for c in ('ux', 'uy', 'uz'))} FROM directed", edges=8, more=_DIRECTED),
        "mean_direction": _q(f"SELECT frame_id, bx, b_y, bz, {means} FROM means", edges=8, more=_DIRECTED),
        "mean_arrow": _q(
            f"SELECT frame_id, bx, b_y, bz, {', '.join(_r4(f'CASE WHEN n > 0 THEN s{a} / n END', f'm{a}') for a in 'xyz')} FROM arrows",
            edges=8,
            more=_DIRECTED + ", arrows AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS n FROM (SELECT frame_id, bx, b_y, bz, avg(ux) FILTER (weight > 0) AS sx, avg(uy) FILTER (weight > 0) AS sy, avg(uz) FILTER (weight > 0) AS sz FROM directed GROUP BY ALL))",
        ),
        "selfloop_vertex": _q("SELECT frame_id, bx, b_y, bz, s.x AS x, s.y AS y, s.z AS z FROM loops", edges=8, more=_LOOPS),
        "block_energy": _q(f"SELECT {block8}, count(*) AS n, {energy} FROM cloud GROUP BY 1, 2, 3, 4"),
        "block_spectrum_trace": _q(f"SELECT o.frame_id, o.bx, o.b_y, o.bz, {_r4('coalesce(sum(2e0 / sqrt(d2)), 0e0)', 'trace')} FROM own o LEFT JOIN edges e ON o.frame_id = e.frame_id AND o.x = e.x AND o.y = e.y AND o.z = e.z GROUP BY 1, 2, 3, 4", edges=2),
        "laplacian_quadratic_form": _q("SELECT o.frame_id, o.bx, o.b_y, o.bz, round(coalesce(sum(1e0 / sqrt(d2) * (e.cy - n_cy) * (e.cy - n_cy)), 0e0), 3) + 0e0 AS form FROM own o LEFT JOIN edges e ON o.frame_id = e.frame_id AND o.x = e.x AND o.y = e.y AND o.z = e.z GROUP BY 1, 2, 3, 4", edges=2),
        "components": _q("SELECT frame_id, x, y, z, component FROM labelled", edges=4, more=_COMPONENTS, recursive=True),
        "component_centroids": _q(f"SELECT frame_id, bx, b_y, bz, component, n, {', '.join(_r4(f'g{a}', f'g{a}') for a in 'xyz')} FROM centroids", edges=4, more=_COMPONENTS, recursive=True),
        "complete_graph_weights": _q(
            f"SELECT frame_id, bx, b_y, bz, i, j, {_r4('2e0 / d', 'w')} FROM (SELECT a.frame_id, a.bx, a.b_y, a.bz, a.component AS i, b.component AS j, sqrt((a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy) + (a.gz - b.gz) * (a.gz - b.gz)) AS d FROM centroids a JOIN centroids b ON a.frame_id = b.frame_id AND a.bx = b.bx AND a.b_y = b.b_y AND a.bz = b.bz AND a.component <> b.component) WHERE d > 0",
            edges=4, more=_COMPONENTS, recursive=True,
        ),
        "ragft_roundtrip": _q(f"SELECT frame_id, x, y, z, {yuv} FROM cloud"),
        "quantized_dc": _q("SELECT level, frame_id, x, y, z, round((round(cy, 4) + 0e0) / 64e0) * 64e0 AS cy FROM pyramid", more=_PYRAMID),
        "psnr_dc": _q(
            f"SELECT frame_id, level, step, n, round(mse, 9) AS mse, {_r4('CASE WHEN mse > 0 THEN -10e0 * log10(mse) END', 'psnr')} FROM (SELECT frame_id, level, CAST(step AS INTEGER) AS step, count(*) AS n, sum((c - round(c / step) * step) * (c - round(c / step) * step)) / (count(*) * (255e0 * 255e0)) AS mse FROM (SELECT frame_id, level, round(cy, 4) + 0e0 AS c FROM pyramid), (VALUES {', '.join(f'({s})' for s in STEPS)}) s(step) GROUP BY 1, 2, 3)",
            more=_PYRAMID,
        ),
        "feature_norms": _q(f"SELECT frame_id, bx, b_y, bz, {', '.join(_r4(m, m) for m in ('m1', 'm2', 'm4'))} FROM feats", edges=8, more=_FEATURES),
        "nearest_centroid": _q(f"SELECT frame_id, bx, b_y, bz, best.c AS cluster, {_r4('best.d', 'distance')} FROM nearest", edges=8, more=_NEAREST),
        "topk_per_centroid": _q(f"SELECT cluster, CAST(rank AS INTEGER) AS rank, frame_id, bx, b_y, bz, {_r4('distance', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, frame_id, bx, b_y, bz) AS rank FROM dists) WHERE rank <= 3", edges=8, more=_DISTS),
        "cluster_sizes": _q("SELECT best.c AS cluster, count(*) AS n FROM nearest GROUP BY 1", edges=8, more=_NEAREST),
        "gradient_histogram": _q("SELECT CAST(CASE WHEN m < 0 THEN 0 WHEN m >= 0.5 THEN 21 ELSE floor(m / 0.5e0 * 20) + 1 END AS BIGINT) AS bin, count(*) AS n FROM (SELECT round(m1, 6) AS m FROM metrics WHERE m1 IS NOT NULL) GROUP BY 1", edges=8, more=_METRICS),
        "sorted_blocks": _q(f"SELECT frame_id, bx, b_y, bz, {_r4('m1', 'm1')}, {_r4('m2', 'm2')} FROM metrics", edges=8, more=_METRICS),
        "axis_extents": _q(f"SELECT {block8}, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, {', '.join(_r4(f'avg({a})', f'mean_{a}') for a in 'xyz')} FROM pts GROUP BY 1, 2, 3, 4"),
        "block_records": _q(
            f"SELECT m.frame_id, m.bx, m.b_y, m.bz, n, {', '.join(_r4(m, m) for m in ('m1', 'm2', 'm3', 'm4'))}, coalesce(n_edges, 0) AS n_edges, {_r4('coalesce(degree_sum, 0e0)', 'degree_sum')}, coalesce(reach, 0) AS reach, place AS selfloop_vertex FROM metrics m LEFT JOIN links k ON m.frame_id = k.frame_id AND m.bx = k.bx AND m.b_y = k.b_y AND m.bz = k.bz LEFT JOIN looped o ON m.frame_id = o.frame_id AND m.bx = o.bx AND m.b_y = o.b_y AND m.bz = o.bz",
            edges=8, more=_RECORDS,
        ),
        "view_checks": _q(f"SELECT frame_id, count(*) AS n, 0::BIGINT AS n_null, count(*) FILTER (least(x, y, z) < 0 OR greatest(x, y, z) >= {_N // 2}) AS n_outside, count(*) - count(DISTINCT (x, y, z)) AS n_repeated FROM pts GROUP BY frame_id"),
    }
