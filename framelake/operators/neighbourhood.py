"""Neighbourhood operators on images: unrolled taps over the planes, one projection each, no shuffle.

Kernels of a fixed size unroll into codegen-friendly sums; for large radii use kernels.image on the compact form.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

#: The Laplacian of edge detection and the emboss kernel.
EDGE = (-1, -1, -1, -1, 8, -1, -1, -1, -1)
EMBOSS = (-2, -1, 0, -1, 1, 1, 0, 1, 2)
AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def per_pixel(df: DataFrame, f: Callable[[Column, Column, Callable], Column]) -> DataFrame:
    """planes with f(value, place, tap) for each value; tap(dx, dy) is the neighbour, edges repeated."""
    w, h = F.col("w"), F.col("h")

    def plane(p: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            x, y = i % w, F.floor(i / w).cast("int")

            def tap(dx: int, dy: int) -> Column:
                tx = F.greatest(F.lit(0), F.least(w - 1, x + dx)) if dx else x
                ty = F.greatest(F.lit(0), F.least(h - 1, y + dy)) if dy else y
                return F.get(p, ty * w + tx)

            return f(v, i, tap)

        return F.transform(p, at)

    return df.withColumn("planes", F.transform("planes", plane))


def inside(i: Column) -> Column:
    """Whether a place has all eight neighbours."""
    w, h = F.col("w"), F.col("h")
    x, y = i % w, F.floor(i / w).cast("int")
    return (x > 0) & (x < w - 1) & (y > 0) & (y < h - 1)


def convolve(df: DataFrame, kernel: tuple[float, ...]) -> DataFrame:
    """A 3x3 kernel divided by its sum (1 where that is 0), clamped and cut; the outermost pixels become 0."""
    scale = sum(kernel) or 1.0

    def value(v, i, tap):
        s = total(tap(dx, dy) * F.lit(float(k / scale)) for k, (dx, dy) in zip(kernel, AROUND) if k)
        return F.when(inside(i), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), s + F.lit(1e-9)))).cast("int")).otherwise(F.lit(0))

    return per_pixel(df, value)


def edge_detect(df: DataFrame, strength: float) -> DataFrame:
    return df if strength <= 0 else convolve(df, tuple(k * strength for k in EDGE))


def emboss(df: DataFrame, strength: float) -> DataFrame:
    return df if strength <= 0 else convolve(df, tuple(k * strength for k in EMBOSS))


def gauss_weights(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian of radius ceil(3 sigma), of sum 1."""
    radius = math.ceil(3 * sigma)
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [(d, w / sum(raw)) for d, w in zip(range(-radius, radius + 1), raw)]


def smooth(df: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian of real values, edges repeated, not rounded."""
    weights = gauss_weights(sigma)
    df = per_pixel(df, lambda v, i, tap: total(tap(d, 0) * F.lit(k) for d, k in weights))
    return per_pixel(df, lambda v, i, tap: total(tap(0, d) * F.lit(k) for d, k in weights))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("planes", F.transform("planes", lambda p: F.transform(p, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)) + F.lit(0.5 + 1e-9)).cast("int"))))


def gaussian_blur(df: DataFrame, sigma: float) -> DataFrame:
    if not math.isfinite(sigma) or sigma < 0:
        raise ValueError("sigma must be finite and not negative")
    return df if sigma == 0 else _rounded(smooth(df, sigma))


blur_mask = smooth


def _with(df: DataFrame, other: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Values of df and of other, a projection of df, put together: both are columns of one row."""
    planes = F.zip_with("planes", "other", lambda p, q: F.zip_with(p, q, f))
    return other.withColumn("planes", planes).drop("other")


def unsharp_mask(df: DataFrame, sigma: float, threshold: int) -> DataFrame:
    """v + (v - blurred) where the difference is above the threshold."""
    if not sigma > 0 or threshold < 0:
        raise ValueError("sigma must be positive and threshold not negative")
    blurred = gaussian_blur(df.withColumn("other", F.col("planes")), sigma)
    sharp = lambda b, v: F.when(F.abs(v - b) > threshold, F.greatest(F.lit(0), F.least(F.lit(255), v + v - b))).otherwise(v)
    return _with(df, blurred, sharp)


def denoise(df: DataFrame, strength: int) -> DataFrame:
    """A blend of the image and its blur by how much the 3x3 neighbours of all planes differ."""
    if strength <= 0:
        return df
    n = min(int(strength), 10)
    threshold = 30.0 * n / 5.0
    kept = df.withColumn("other", F.col("planes"))
    blurred = gaussian_blur(kept, 0.5 * n)
    w, h = F.col("w"), F.col("h")

    def variance(other: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w).cast("int")
        near = lambda p: total(F.abs(F.get(p, F.greatest(F.lit(0), F.least(h - 1, y + dy)) * w + F.greatest(F.lit(0), F.least(w - 1, x + dx))) - F.get(p, i)) for dx, dy in AROUND)
        return F.aggregate(F.transform(other, near), F.lit(0.0), lambda s, v: s + v) / (F.size(other) * F.lit(9.0))

    blend = let(F.col("other"), lambda other: F.transform(F.sequence(F.lit(0), w * h - 1), lambda i: F.least(F.lit(1.0), variance(other, i) / F.lit(threshold))))
    mixed = lambda k: F.zip_with("planes", "other", lambda b, v: F.transform(v, lambda o, i: F.floor(o * F.get(k, i) + F.get(b, i) * (F.lit(1.0) - F.get(k, i)) + F.lit(0.5 + 1e-9)).cast("int")))
    return blurred.withColumn("planes", let(blend, mixed)).drop("other")


def deinterlace(df: DataFrame, field: int = 0) -> DataFrame:
    """Keeps the lines of a field (0: even, 1: odd); the others become the mean of the lines above and below."""
    y = lambda i: F.floor(i / F.col("w")).cast("int")
    h = F.col("h")
    above = lambda i, v, tap: F.when(y(i) > 0, tap(0, -1)).otherwise(v)
    below = lambda i, v, tap: F.when(y(i) < h - 1, tap(0, 1)).otherwise(v)
    return per_pixel(df, lambda v, i, tap: F.when(y(i) % 2 == field % 2, v).otherwise(F.floor((above(i, v, tap) + below(i, v, tap)) / 2).cast("int")))


def dilate(df: DataFrame, iterations: int = 1) -> DataFrame:
    for _ in range(iterations):
        df = per_pixel(df, lambda v, i, tap: F.greatest(*(tap(d, 0) for d in (-1, 0, 1))))
        df = per_pixel(df, lambda v, i, tap: F.greatest(*(tap(0, d) for d in (-1, 0, 1))))
    return df


def erode(df: DataFrame, iterations: int = 1) -> DataFrame:
    for _ in range(iterations):
        df = per_pixel(df, lambda v, i, tap: F.least(*(tap(d, 0) for d in (-1, 0, 1))))
        df = per_pixel(df, lambda v, i, tap: F.least(*(tap(0, d) for d in (-1, 0, 1))))
    return df


def sobel_edges(df: DataFrame, threshold: int = 50) -> DataFrame:
    """255 where a quarter of the Sobel magnitude is above a threshold; the outermost pixels are 0."""

    def value(v, i, tap):
        gx = tap(1, -1) + 2 * tap(1, 0) + tap(1, 1) - tap(-1, -1) - 2 * tap(-1, 0) - tap(-1, 1)
        gy = tap(-1, 1) + 2 * tap(0, 1) + tap(1, 1) - tap(-1, -1) - 2 * tap(0, -1) - tap(1, -1)
        magnitude = F.floor(F.least(F.lit(255.0), F.sqrt((gx * gx + gy * gy).cast("double")) / F.lit(4.0)))
        return F.when(inside(i) & (magnitude > threshold), 255).otherwise(0)

    return per_pixel(df, value)


def box_mean(df: DataFrame, radius: int) -> DataFrame:
    """The mean of a square, clipped at the edges: sums along rows, then along columns."""
    w, h = F.col("w"), F.col("h")
    summed = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double"))

    def along_rows(p: Column) -> Column:
        def at(i: Column) -> Column:
            x = i % w
            first, last = F.greatest(x - radius, F.lit(0)), F.least(x + radius, w - 1)
            return summed(F.slice(p, i - x + first + 1, last - first + 1))

        return F.transform(F.sequence(F.lit(0), w * h - 1), at)

    def along_columns(p: Column) -> Column:
        def at(i: Column) -> Column:
            x, y = i % w, F.floor(i / w).cast("int")
            first, last = F.greatest(y - radius, F.lit(0)), F.least(y + radius, h - 1)
            wide = F.least(x + radius, w - 1) - F.greatest(x - radius, F.lit(0)) + 1
            return summed(F.transform(F.sequence(first, last), lambda j: F.get(p, j * w + x))) / (wide * (last - first + 1))

        return F.transform(F.sequence(F.lit(0), w * h - 1), at)

    df = df.withColumn("planes", F.transform("planes", along_rows))
    return df.withColumn("planes", F.transform("planes", along_columns))


def guided_filter(df: DataFrame, radius: int = 15, eps: float = 0.01) -> DataFrame:
    """planes[0]: the guide, planes[1]: the mask, both 0..1; gives the mask led by the guide as the only plane."""
    g, m = F.col("planes")[0], F.col("planes")[1]
    times = lambda a, b: F.zip_with(a, b, lambda u, v: u * v)
    means = box_mean(df.withColumn("planes", F.array(g, m, times(g, m), times(g, g))), radius)
    four = F.arrays_zip(*(F.col("planes")[k].alias(n) for k, n in enumerate(("i", "p", "ip", "ii"))))
    a = F.transform(four, lambda z: (z["ip"] - z["i"] * z["p"]) / (z["ii"] - z["i"] * z["i"] + F.lit(eps)))
    means = means.withColumn("a", a)
    b = F.zip_with("a", four, lambda a, z: z["p"] - a * z["i"])
    again = box_mean(means.withColumn("planes", F.array(F.col("a"), b)).drop("a"), radius)
    # the guide itself is needed again
    guide = df.select("image_id", g.alias("guide"))
    out = again.join(guide, "image_id")
    value = F.zip_with(F.zip_with(F.col("planes")[0], "guide", lambda a, i: a * i), F.col("planes")[1], lambda ai, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), ai + b)))
    return out.select("image_id", "w", "h", F.array(value).alias("planes"))
