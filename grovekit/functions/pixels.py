"""Colour of pixel rows as column expressions (PRJ-23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published sRGB (D65) matrix, white point and CIE constants.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def srgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L, a, b of sRGB values in 0..1."""
    lin = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in (r, g, b)]
    xyz = [sum((c * k for c, k in zip(lin[1:], row[1:], strict=True)), lin[0] * row[0]) / w for row, w in zip(XYZ, WHITE, strict=True)]
    f = [F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise(7.787 * v + 16 / 116) for v in xyz]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])
