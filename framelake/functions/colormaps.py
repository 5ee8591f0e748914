"""Colour maps as Column expressions: a level of 0..1 to r, g, b (cut to 0..255)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cubic coefficients of r, g and b, lowest power first.
CUBIC = {
    "viridis": ((0.267, 0.003, 1.169, -0.433), (0.004, 0.874, -0.195, 0.114), (0.329, 0.675, -0.756, 0.346)),
    "plasma": ((0.050, 2.740, -3.030, 1.250), (0.030, 0.500, 0.450, 0.0), (0.530, 0.480, -1.450, 0.640)),
}
NAMES = ("viridis", "plasma", "jet", "grayscale", "green")


def _cut(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255.0 + F.lit(1e-9)).cast("int")


def colormap(level: Column, name: str) -> Column:
    if name not in NAMES:
        raise ValueError(f"unknown colour map {name}")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), level))
    if name in CUBIC:
        parts = [F.lit(a) + t * (F.lit(b) + t * (F.lit(c) + t * F.lit(d))) for a, b, c, d in CUBIC[name]]
    elif name == "jet":
        # each channel is a trapezium of slope 4 around its own middle
        parts = [F.lit(1.5) - 4.0 * F.abs(t - F.lit(middle)) for middle in (0.75, 0.5, 0.25)]
    else:
        parts = [t if name == "grayscale" or k == 1 else F.lit(0.0) for k in range(3)]
    return F.struct(*(_cut(p).alias(c) for p, c in zip(parts, "rgb")))
