import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import codec


def bit_by_bit(values):
    """The coder value by value, with no tokens."""
    kp, krp, bits, i, n = *codec._START, 0, 0, len(values)
    while i < n:
        k = kp >> 2
        run = 0
        while k and i < n and run < 1 << k and values[i] == 0:
            run, i = run + 1, i + 1
        if k and run == 1 << k:
            bits, kp = bits + 1, min(120, kp + 4)
            continue
        if k and i == n:
            bits += 1 + k
            break
        u = 2 * values[i] if values[i] >= 0 else -2 * values[i] - 1
        bits, u = (bits + 1 + k, u - 1) if k else (bits, u)
        p = u >> (krp >> 2)
        bits += p + 1 + (krp >> 2)
        krp = max(0, krp - 2) if p == 0 else min(120, krp + p + 1) if p > 1 else krp
        kp = max(0, kp - 6) if k else kp + 3 if values[i] == 0 else max(0, kp - 1)
        i += 1
    return bits


def channels():
    r = np.random.default_rng(5)
    yield []
    yield [0] * 5000
    yield [0, 0, 0, 7]
    for scale, share in ((0.4, 0.5), (3, 0.2), (300, 0.9), (20, 0.02)):
        yield np.round(r.laplace(0, scale, 3000) * (r.random(3000) < share)).astype(int).tolist()


@pytest.mark.parametrize("values", list(channels()))
def test_segments_chain_to_the_sequential_coder(values):
    want = bit_by_bit(values)
    assert codec.run_length_bits(values) == want
    x = np.array(values, np.int64)
    for size in (1, 7, 500, 10_000):
        if size > 1 or len(values) < 10:
            parts = [codec._segment(x[a : a + size], a == 0) for a in range(0, len(x), size)]
            assert codec.combined(parts) == want
            # Whether it starts the channel need not be known.
            assert codec.combined([codec._segment(x[a : a + size], False) for a in range(0, len(x), size)]) == want


@pytest.mark.parametrize("segment", [50, 1 << 16])
def test_channel_sizes_match_the_ordered_channel(spark, segment, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(f, level, int(b[0]), int(b[1]), int(b[2]), k, *(float(v) for v in r.laplace(0, 9, 3)), 0.0, 1.0) for f in (0, 1, 3) for level in (1, 2, 3) for b in np.unique(r.integers(0, 6, (40, 3)), axis=0) for k in ((0, 1, 2) if level == 1 else (1, 2))]
    schema = "frame_id int, level int, bx long, b_y long, bz long, k int, c0 double, c1 double, c2 double, freq double, weight double"
    monkeypatch.setattr(codec, "SEGMENT", segment)
    got = {(x["frame_id"], x["step"], x["channel"]): x for x in codec.channel_sizes(spark.createDataFrame(rows, schema), (1, 8)).collect()}
    spread = lambda v: sum(((v >> i) & 1) << 3 * i for i in range(4))
    key = lambda x: (0 if x[5] == 0 else x[1], spread(x[2]) << 2 | spread(x[3]) << 1 | spread(x[4]), x[5])
    for (f, step, c), x in got.items():
        own = [y[6 + c] for y in sorted((y for y in rows if y[0] == f), key=key)]
        q = [int(np.sign(v) * np.floor(abs(v) / step + 0.5)) for v in own]
        assert x["n"] == len(own) and x["bytes"] == (bit_by_bit(q) + 7) // 8
        assert abs(x["error"] - sum((v - w * step) ** 2 for v, w in zip(own, q, strict=True))) < 1e-6
    rd = codec.rate_distortion(spark.createDataFrame(rows, schema), (1, 8)).join(codec.distortion(spark.createDataFrame(rows, schema), (1, 8)).select("frame_id", "step", F.col("mse").alias("m2"), "n"), ["frame_id", "step"]).collect()
    assert len(rd) == 6 and all(abs(x["mse"] - x["m2"]) < 1e-12 and x["nvox"] == x["n"] for x in rd)
