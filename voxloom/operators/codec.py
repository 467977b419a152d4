"""Quantisation, distortion and size of coefficients over sweeps of steps."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.color import dequantise, quantise
from voxloom.functions.space import BLOCK, morton

COLUMNS = ("c0", "c1", "c2")


def quantised(coeffs: DataFrame, step: float | Column, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    return coeffs.withColumns({c: dequantise(quantise(F.col(c), step), step) for c in columns})


def with_steps(coeffs: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """Every row once for each step."""
    return coeffs.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))


def distortion(coeffs: DataFrame, steps: tuple[int, ...], column: str = "c0", by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """(by, step, n, mse, psnr) of one channel; mse is normalised by 255 squared. Zero error has no psnr."""
    each = with_steps(coeffs.select(*by, column), steps)
    error = F.col(column) - dequantise(quantise(F.col(column), F.col("step")), F.col("step"))
    out = each.groupBy(*by, "step").agg(F.count("*").alias("n"), (F.sum(error * error) / (F.count("*") * (255.0 * 255.0))).alias("mse"))
    return out.withColumn("psnr", F.when(F.col("mse") > 0, -10.0 * F.log10("mse")))


#: Values of the coder's two parameters, k of runs and kr of magnitudes, both kept in quarters.
_TOP = 120
_STATES = (_TOP + 1) ** 2
#: Parameters that a channel starts with.
_START = (0, 8)
#: Coefficients of a segment.
SEGMENT = 1 << 16

Token = tuple[int, int]


def _coded(kp: int, krp: int, zeros: int, value: int | None) -> tuple[int, int, int]:
    """(k, kr, bits) after a run of zeros and the value that ends it (None: the channel ends)."""
    bits = 0
    while zeros:
        k = kp >> 2
        if not k:
            bits, krp, kp, zeros = bits + 1 + (krp >> 2), max(0, krp - 2), kp + 3, zeros - 1
        elif zeros >> k:
            bits, kp, zeros = bits + 1, min(_TOP, kp + 4), zeros - (1 << k)
        else:
            break
    k = kp >> 2
    if value is None:
        return kp, krp, bits + (1 + k if zeros else 0)
    u = 2 * value if value >= 0 else -2 * value - 1
    u, bits = (u - 1, bits + 1 + k) if k else (u, bits)
    p = u >> (krp >> 2)
    bits += p + 1 + (krp >> 2)
    krp = max(0, krp - 2) if p == 0 else min(_TOP, krp + p + 1) if p > 1 else krp
    return max(0, kp - (6 if k else 1)), krp, bits


def tokens(values: np.ndarray) -> tuple[list[Token], int]:
    """((zeros before, value) of each value that is not 0, zeros at the end)."""
    at = np.flatnonzero(values)
    gaps = np.diff(np.concatenate([[-1], at])) - 1
    return list(zip(gaps.tolist(), values[at].tolist(), strict=True)), int(len(values) - (at[-1] + 1 if len(at) else 0))


def run_length_bits(values: list[int]) -> int:
    """Length in bits of an adaptive run-length and Golomb-Rice code of a sequence.

    The parameters k (runs) and kr (magnitudes) are kept in quarters and follow the
    values; they are this code's own choice after the published scheme.
    """
    each, tail = tokens(np.asarray(values, np.int64))
    kp, krp = _START
    total = 0
    for zeros, value in each:
        kp, krp, bits = _coded(kp, krp, zeros, value)
        total += bits
    return total + _coded(kp, krp, tail, None)[2]


def transition(each: list[Token]) -> tuple[np.ndarray, np.ndarray]:
    """(state after, bits) of tokens for every state (k * 121 + kr) that the coder may be in before them.

    All states are carried on together; those that have become equal go on as one, and
    once one is left it goes on alone.
    """
    kp, krp = np.divmod(np.arange(_STATES), _TOP + 1)
    of, base, bits = np.arange(_STATES), np.zeros(_STATES, np.int64), np.zeros(_STATES, np.int64)
    done = 0
    while done < len(each) and len(kp) > 1:
        for zeros, value in each[done : done + 4]:
            left = np.full(len(kp), zeros)
            while True:
                k = kp >> 2
                plain, run = (left > 0) & (k == 0), (left > 0) & (k > 0) & (left >> np.minimum(k, 62) > 0)
                if not (plain | run).any():
                    break
                bits = bits + np.where(plain, 1 + (krp >> 2), run)
                krp = np.where(plain, np.maximum(0, krp - 2), krp)
                left = left - np.where(plain, 1, np.where(run, 1 << np.where(run, k, 0), 0))
                kp = np.where(plain, kp + 3, np.where(run, np.minimum(_TOP, kp + 4), kp))
            k, u = kp >> 2, 2 * value if value >= 0 else -2 * value - 1
            u = np.where(k > 0, u - 1, u)
            p = u >> (krp >> 2)
            bits = bits + np.where(k > 0, 1 + k, 0) + p + 1 + (krp >> 2)
            krp = np.where(p == 0, np.maximum(0, krp - 2), np.where(p > 1, np.minimum(_TOP, krp + p + 1), krp))
            kp = np.maximum(0, kp - np.where(k > 0, 6, 1))
        done = min(len(each), done + 4)
        names, first, back = np.unique(kp * (_TOP + 1) + krp, return_index=True, return_inverse=True)
        base, bits = base + bits[of], np.zeros(len(names), np.int64)
        of, kp, krp = back[of], kp[first], krp[first]
    base = base + bits[of]
    if done < len(each):
        a, b, total = int(kp[0]), int(krp[0]), 0
        for zeros, value in each[done:]:
            a, b, more = _coded(a, b, zeros, value)
            total += more
        return np.full(_STATES, a * (_TOP + 1) + b), base + total
    return (kp * (_TOP + 1) + krp)[of], base


def _segment(values: np.ndarray, starts: bool) -> dict[str, object]:
    """What is to be known of a segment: its leading zeros and first other value, its zeros at the end, and the transition between.

    A segment that starts a channel needs no more than the one state after its last token.
    """
    each, tail = tokens(values)
    if starts or not each:
        kp, krp = _START
        total = 0
        for zeros, value in each:
            kp, krp, bits = _coded(kp, krp, zeros, value)
            total += bits
        return {"lead": 0, "value": None, "tail": tail, "state": kp * (_TOP + 1) + krp, "bits": total, "after": None, "sizes": None}
    after, sizes = transition(each[1:])
    pack = lambda x: zlib.compress(x.astype("<i8").tobytes(), 1)
    return {"lead": each[0][0], "value": each[0][1], "tail": tail, "state": None, "bits": None, "after": pack(after), "sizes": pack(sizes)}


def combined(segments: list[dict[str, object]]) -> int:
    """Bits of a channel from its segments in order."""
    (kp, krp), zeros, total = _START, 0, 0
    for i, s in enumerate(segments):
        if s["value"] is None:
            # The first segment, or one of zeros alone.
            if i == 0 and s["state"] is not None:
                (kp, krp), total = divmod(s["state"], _TOP + 1), s["bits"]
            zeros += s["tail"]
            continue
        kp, krp, bits = _coded(kp, krp, zeros + s["lead"], s["value"])
        after, sizes = (np.frombuffer(zlib.decompress(s[c]), "<i8") for c in ("after", "sizes"))
        state = kp * (_TOP + 1) + krp
        total += bits + int(sizes[state])
        (kp, krp), zeros = divmod(int(after[state]), _TOP + 1), s["tail"]
    return total + _coded(kp, krp, zeros, None)[2]


_PARTS = "frame_id int, step int, channel int, place long, lead long, value long, tail long, state long, bits long, after binary, sizes binary, n long, error double"


def ordered(coeffs: DataFrame, bits: int = 16) -> DataFrame:
    """coeffs sorted over all tasks as a frame's channel is coded: lowest coefficients, then the levels from the coarsest, each in Morton order of its blocks."""
    group = F.when(F.col("k") == 0, 0).otherwise(F.col("level"))
    keyed = coeffs.withColumn("__group", group).withColumn("__m", morton(bits, BLOCK))
    order = ("frame_id", "__group", "__m", "k")
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__m", "__group")


def channel_sizes(coeffs: DataFrame, steps: tuple[int, ...], columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(frame_id, step, channel, n, error, bytes): each channel of a frame coded as one sequence, and the squared error of its quantised values.

    Tasks code segments of the sorted coefficients for every state that the coder may be in
    at their beginning; one row a segment meets the others of its channel, and
    these are chained in order. The sizes are those of the sequential coder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, seen = TaskContext.get().partitionId(), 0, None
        held: list[np.ndarray] = []

        def told(rows: np.ndarray, starts: bool) -> Iterator[pa.RecordBatch]:
            out = []
            for step in steps:
                # Halves go away from zero, as in quantise.
                q = np.sign(rows[:, 1:]) * np.floor(np.abs(rows[:, 1:]) / step + 0.5)
                for c in range(len(columns)):
                    error = float(np.square(rows[:, 1 + c] - q[:, c] * step).sum())
                    out.append({"frame_id": int(rows[0, 0]), "step": step, "channel": c, "place": part << 32 | number, "n": len(rows), "error": error, **_segment(q[:, c].astype(np.int64), starts)})
            yield pa.RecordBatch.from_pylist(out, _schema(_PARTS))

        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(np.stack([batch.column(c).to_numpy().astype(np.float64) for c in ("frame_id", *columns)], 1))
            while held and (batch is None or sum(map(len, held)) >= SEGMENT):
                rows = np.concatenate(held)
                cut = min(SEGMENT, int(np.searchsorted(rows[:, 0], rows[0, 0], side="right")))
                # Behind another frame's rows, a frame begins here; the partition's first may have begun before.
                yield from told(rows[:cut], seen is not None and seen != rows[0, 0])
                seen, number, held = rows[0, 0], number + 1, [rows[cut:]] if cut < len(rows) else []

    parts = ordered(coeffs).select("frame_id", *columns).mapInArrow(run, _PARTS)

    def chained(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        out = {"frame_id": rows[0]["frame_id"], "step": rows[0]["step"], "channel": rows[0]["channel"], "n": sum(r["n"] for r in rows), "error": sum(r["error"] for r in rows), "bytes": (combined(rows) + 7) // 8}
        return pa.Table.from_pylist([out], _schema(_SIZES))

    return parts.groupBy("frame_id", "step", "channel").applyInArrow(chained, _SIZES)


_SIZES = "frame_id int, step int, channel int, n long, error double, bytes long"


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in text.split(", ")])


def coded_bytes(coeffs: DataFrame, steps: tuple[int, ...], columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(frame_id, step, bytes): size of all channels."""
    return channel_sizes(coeffs, steps, columns).groupBy("frame_id", "step").agg(F.sum("bytes").alias("bytes"))


def rate_distortion(coeffs: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """(frame_id, step, nvox, mse, psnr, bytes), from one pass over the sorted coefficients."""
    first = lambda c: F.sum(F.when(F.col("channel") == 0, F.col(c)))
    out = channel_sizes(coeffs, steps).groupBy("frame_id", "step").agg(first("n").alias("nvox"), (first("error") / (first("n") * (255.0 * 255.0))).alias("mse"), F.sum("bytes").alias("bytes"))
    return out.select("frame_id", "step", "nvox", "mse", F.when(F.col("mse") > 0, -10.0 * F.log10("mse")).alias("psnr"), "bytes")
