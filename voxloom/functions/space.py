"""Block keys and Morton codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
BLOCK = ("bx", "b_y", "bz")


def block_of(size: int, axes: tuple[str, ...] = AXES, names: tuple[str, ...] = BLOCK) -> list[Column]:
    """Coarse coordinates floor(v / size); a shift, since sizes are powers of two."""
    shift = size.bit_length() - 1
    return [F.shiftright(F.col(a).cast("long"), shift).alias(n) for a, n in zip(axes, names, strict=True)]


def morton(bits: int, axes: tuple[str, ...] = AXES) -> Column:
    """Interleaved bits of the coordinates, x highest."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, a in enumerate(reversed(axes)):
            bit = F.shiftright(F.col(a).cast("long"), i).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, 3 * i + k))
    return out
