"""Colour conversion, quantisation and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RGB/255 (and 1) to YUV, one row per input, and its inverse.
TO_YUV = ((0.29899999, -0.1687, 0.5), (0.587, -0.3313, -0.4187), (0.114, 0.5, -0.0813), (0.0, 0.50196078, 0.50196078))
TO_RGB = ((1.0, 1.0, 1.0), (0.0, -0.34414, 1.772), (1.402, -0.71414, 0.0), (-0.703749019, 0.53121505, -0.88947451))


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def rgb_to_yuv(red: str = "red", green: str = "green", blue: str = "blue", clip: bool = True) -> dict[str, Column]:
    """cy, cu, cv on 0..255, not rounded.

    clip: pure red and pure blue (with 0 or 1 of one other colour) lie beyond the range by up to half a step and are cut to it, so
    that they do not come back; without it every colour does.
    """
    r, g, b = (F.col(c).cast("double") / 255.0 for c in (red, green, blue))
    raw = [r * TO_YUV[0][i] + g * TO_YUV[1][i] + b * TO_YUV[2][i] + TO_YUV[3][i] for i in range(3)]
    return {n: 255.0 * (_clip(c) if clip else c) for n, c in zip(("cy", "cu", "cv"), raw, strict=True)}


def yuv_to_rgb(cy: str = "cy", cu: str = "cu", cv: str = "cv") -> dict[str, Column]:
    """red, green, blue as integers of 0..255, rounded half up."""
    y, u, v = F.col(cy) / 255.0, F.col(cu) / 255.0, F.col(cv) / 255.0
    return {n: F.floor(255.0 * _clip(y * TO_RGB[0][i] + u * TO_RGB[1][i] + v * TO_RGB[2][i] + TO_RGB[3][i]) + 0.5).cast("int") for i, n in enumerate(("red", "green", "blue"))}


def quantise(c: Column, step: float | Column) -> Column:
    """Uniform quantisation; halves go away from zero."""
    return F.round(c / step)


def dequantise(c: Column, step: float | Column) -> Column:
    return c * step


def luma(c: str = "cy") -> Column:
    """Luminance on the scale of the gradient features."""
    return F.col(c) / 256.0
