"""Geometric operators on images: each output plane gathers from its input plane, without a shuffle or a join.

An operator changes w, h and planes of an image row. Index maps are higher-order functions over the row-major planes;
places outside the input take the fill (0, or a colour by plane).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

NEAREST, BILINEAR = "nearest", "bilinear"
ANCHORS = {"tl": (0, 0), "t": (1, 0), "tr": (2, 0), "l": (0, 1), "center": (1, 1), "r": (2, 1), "bl": (0, 2), "b": (1, 2), "br": (2, 2)}
Map = Callable[[Column, Column], tuple[Column, Column]]


def width_of() -> Column:
    return F.col("w")


def height_of() -> Column:
    return F.col("h")


def rounded(v: Column) -> Column:
    return F.floor(v + F.lit(0.5)).cast("int")


def whole(v) -> Column:
    return v.cast("int") if isinstance(v, Column) else F.lit(int(v))


def fills(color: tuple[int, ...] | None, n: int) -> list[int]:
    """A colour's value for each of n planes: L from R, LA from R and A, RGB, RGBA."""
    r, g, b, a = color or (0, 0, 0, 0)
    return {1: [r], 2: [r, a], 3: [r, g, b], 4: [r, g, b, a]}[n]


def _planes(f: Callable[[Column, Column], Column], color) -> Column:
    """planes with f(plane, fill) applied to each."""
    if color is None:
        return F.transform("planes", lambda p: f(p, F.lit(0)))
    fill = F.when(F.size("planes") <= 2, F.array(F.lit(color[0]), F.lit(color[3]))).otherwise(F.array(*(F.lit(c) for c in color)))
    return F.transform("planes", lambda p, k: f(p, F.get(fill, k)))


def _canvas(df: DataFrame, ow: Column, oh: Column, planes: Column) -> DataFrame:
    # other names first, as a lambda would see the new w and h
    df = df.select("image_id", ow.alias("new_w"), oh.alias("new_h"), planes.alias("planes"))
    return df.select("image_id", F.col("new_w").alias("w"), F.col("new_h").alias("h"), "planes")


def gather(df: DataFrame, ow, oh, source: Callable, color=None, known: Column | None = None) -> DataFrame:
    """Integer places: out(x, y) = in(source(x, y)), or in(source(x, y, known)) with a value known for the row."""
    ow, oh = whole(ow), whole(oh)

    def planes(row: Column) -> Column:
        def value(plane: Column, fill: Column):
            def at(i: Column) -> Column:
                x, y = i % row["ow"], F.floor(i / row["ow"]).cast("int")
                sx, sy = source(x, y) if known is None else source(x, y, row["known"])
                inside = (sx >= 0) & (sx < width_of()) & (sy >= 0) & (sy < height_of())
                return F.when(inside, F.get(plane, (sy * width_of() + sx).cast("int"))).otherwise(fill)

            return F.transform(F.sequence(F.lit(0), row["ow"] * row["oh"] - 1), at)

        return _planes(value, color)

    row = F.struct(ow.alias("ow"), oh.alias("oh"), *([known.alias("known")] if known is not None else []))
    return _canvas(df, ow, oh, let(row, planes))


def sample(df: DataFrame, ow, oh, source: Map, interpolation: str = BILINEAR) -> DataFrame:
    """Real places: nearest (rounded half up) or bilinear; a place outside 0..w-1, 0..h-1 is 0."""
    if interpolation not in (NEAREST, BILINEAR):
        raise ValueError(f"unknown interpolation {interpolation}")
    ow, oh = whole(ow), whole(oh)

    def value(plane: Column, fill: Column):
        def at(i: Column) -> Column:
            sx, sy = source((i % ow).cast("double"), F.floor(i / ow).cast("double"))
            inside = (sx >= 0) & (sy >= 0) & (sx <= width_of() - 1) & (sy <= height_of() - 1)
            if interpolation == NEAREST:
                return F.when(inside, F.get(plane, rounded(sy) * width_of() + rounded(sx))).otherwise(F.lit(0))
            x0, y0 = F.floor(sx).cast("int"), F.floor(sy).cast("int")
            x1, y1 = F.least(x0 + 1, width_of() - 1), F.least(y0 + 1, height_of() - 1)
            dx, dy = sx - x0, sy - y0
            tap = lambda x, y: F.get(plane, y * width_of() + x).cast("double")
            top = tap(x0, y0) * (F.lit(1.0) - dx) + tap(x1, y0) * dx
            bottom = tap(x0, y1) * (F.lit(1.0) - dx) + tap(x1, y1) * dx
            # a hair above, so that .5 rounds up whatever the order of the sums
            return F.when(inside, rounded(top * (F.lit(1.0) - dy) + bottom * dy + F.lit(1e-9))).otherwise(F.lit(0))

        return F.transform(F.sequence(F.lit(0), ow * oh - 1), at)

    return _canvas(df, ow, oh, _planes(value, None))


def flip_horizontal(df: DataFrame) -> DataFrame:
    return gather(df, width_of(), height_of(), lambda x, y: (width_of() - 1 - x, y))


def flip_vertical(df: DataFrame) -> DataFrame:
    return gather(df, width_of(), height_of(), lambda x, y: (x, height_of() - 1 - y))


def rotate_180(df: DataFrame) -> DataFrame:
    return df.withColumn("planes", F.transform("planes", F.reverse))


flip_both = rotate_180


def rotate_90(df: DataFrame) -> DataFrame:
    """Clockwise."""
    return gather(df, height_of(), width_of(), lambda x, y: (y, height_of() - 1 - x))


def rotate_270(df: DataFrame) -> DataFrame:
    return gather(df, height_of(), width_of(), lambda x, y: (width_of() - 1 - y, x))


rotate_90_cw, rotate_90_ccw, rotate_270_cw = rotate_90, rotate_270, rotate_270


def transpose(df: DataFrame) -> DataFrame:
    return gather(df, height_of(), width_of(), lambda x, y: (y, x))


def transverse(df: DataFrame) -> DataFrame:
    return gather(df, height_of(), width_of(), lambda x, y: (width_of() - 1 - y, height_of() - 1 - x))


def _exact(angle: float):
    angle %= 360.0
    for k, f in enumerate((lambda d: d, rotate_90, rotate_180, rotate_270, lambda d: d)):
        if abs(angle - 90.0 * k) < 1e-4:
            return f
    return None


def _rotation(angle: float, min_x: Column, min_y: Column) -> Map:
    cos, sin = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    cx, cy = (width_of() - 1) / F.lit(2.0), (height_of() - 1) / F.lit(2.0)
    return lambda x, y: (F.lit(cos) * (x + min_x) + F.lit(sin) * (y + min_y) + cx, F.lit(-sin) * (x + min_x) + F.lit(cos) * (y + min_y) + cy)


def rotate_bounded(df: DataFrame, angle: float, interpolation: str = BILINEAR) -> DataFrame:
    """Clockwise by degrees; the canvas grows to hold all corners."""
    if f := _exact(angle):
        return f(df)
    cos, sin = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    hw, hh = (width_of() - 1) / F.lit(2.0), (height_of() - 1) / F.lit(2.0)
    ex = F.lit(abs(cos)) * hw + F.lit(abs(sin)) * hh
    ey = F.lit(abs(sin)) * hw + F.lit(abs(cos)) * hh
    return sample(df, F.ceil(F.lit(2.0) * ex) + 1, F.ceil(F.lit(2.0) * ey) + 1, _rotation(angle, -ex, -ey), interpolation)


rotate = rotate_bounded


def rotate_cropped(df: DataFrame, angle: float, interpolation: str = BILINEAR) -> DataFrame:
    """Clockwise by degrees on the same canvas."""
    if f := _exact(angle):
        out = f(df)
        return out if f not in (rotate_90, rotate_270) else df.select("image_id", "w", "h").join(out.drop("w", "h"), "image_id").select("image_id", "w", "h", "planes")
    return sample(df, width_of(), height_of(), _rotation(angle, -(width_of() - 1) / F.lit(2.0), -(height_of() - 1) / F.lit(2.0)), interpolation)


def crop(df: DataFrame, x, y, width, height) -> DataFrame:
    """A rectangle; one that is empty or leaves an image fails the job with a message."""
    x, y, width, height = (whole(v) for v in (x, y, width, height))
    bad = (width <= 0) | (height <= 0) | (x < 0) | (y < 0) | (x + width > width_of()) | (y + height > height_of())
    checked = F.when(bad, F.raise_error(F.lit("crop is out of bounds")).cast("int")).otherwise(width)
    return gather(df, checked, height, lambda i, j, k: (i + k["x"], j + k["y"]), known=F.struct(x.alias("x"), y.alias("y")))


def crop_center(df: DataFrame, width: int, height: int) -> DataFrame:
    return crop(df, F.floor((width_of() - width) / 2), F.floor((height_of() - height) / 2), width, height)


def crop_to_aspect(df: DataFrame, ratio: float, anchor: str = "center") -> DataFrame:
    if not ratio > 0:
        raise ValueError("ratio must be positive")
    wide = width_of() / height_of() > ratio
    width = F.when(wide, F.greatest(F.lit(1), rounded(height_of() * F.lit(float(ratio))))).otherwise(width_of())
    height = F.when(wide, height_of()).otherwise(F.greatest(F.lit(1), rounded(width_of() / F.lit(float(ratio)))))
    ax, ay = ANCHORS[anchor]
    return crop(df, F.floor((width_of() - width) * ax / 2), F.floor((height_of() - height) * ay / 2), width, height)


def crop_percentage(df: DataFrame, top: float, right: float, bottom: float, left: float) -> DataFrame:
    if min(top, right, bottom, left) < 0 or max(top, right, bottom, left) > 100:
        raise ValueError("percentages lie between 0 and 100")
    x, y = rounded(width_of() * F.lit(left / 100.0)), rounded(height_of() * F.lit(top / 100.0))
    width = F.greatest(F.lit(1), width_of() - x - rounded(width_of() * F.lit(right / 100.0)))
    height = F.greatest(F.lit(1), height_of() - y - rounded(height_of() * F.lit(bottom / 100.0)))
    return crop(df, F.least(x, width_of() - 1), F.least(y, height_of() - 1), width, height)


def bounds(df: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds x0, x1, y0, y1 of the places i with keep(planes, i), or null."""
    places = let(F.col("planes"), lambda planes: F.filter(F.sequence(F.lit(0), width_of() * height_of() - 1), lambda i: keep(planes, i)))
    df = df.withColumn("at", places)
    xs, ys = F.transform("at", lambda i: i % width_of()), F.transform("at", lambda i: F.floor(i / width_of()).cast("int"))
    return df.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}).drop("at")


def _crop_to_bounds(df: DataFrame) -> DataFrame:
    x, y = F.coalesce("x0", F.lit(0)), F.coalesce("y0", F.lit(0))
    return crop(df, x, y, F.coalesce(F.col("x1") + 1, width_of()) - x, F.coalesce(F.col("y1") + 1, height_of()) - y)


def autocrop(df: DataFrame, tolerance: int = 0) -> DataFrame:
    """Cuts borders that equal the first pixel up to a tolerance; an image of nothing else stays."""
    off = lambda planes, i: F.exists(planes, lambda p: F.abs(F.get(p, i) - F.get(p, F.lit(0))) > tolerance)
    return _crop_to_bounds(bounds(df, off))


trim = autocrop


def _alpha(threshold: int = 0):
    return lambda planes, i: F.get(F.element_at(planes, -1), i) > threshold


def crop_to_content(df: DataFrame) -> DataFrame:
    """The bounding box of alpha above 0; images without alpha stay."""
    keep = _alpha()
    return _crop_to_bounds(bounds(df, lambda planes, i: F.when(F.size(planes) % 2 == 0, keep(planes, i)).otherwise(F.lit(True))))


def pad(df: DataFrame, top, right, bottom, left, color=(0, 0, 0, 0)) -> DataFrame:
    top, right, bottom, left = (whole(v) for v in (top, right, bottom, left))
    return gather(df, width_of() + left + right, height_of() + top + bottom, lambda x, y: (x - left, y - top), color)


def align(df: DataFrame, width: int, height: int, anchor: str = "center", color=(0, 0, 0, 0)) -> DataFrame:
    """Puts an image on a canvas that is at least as large, else the job fails."""
    ax, ay = ANCHORS[anchor]
    small = (F.lit(width) < width_of()) | (F.lit(height) < height_of())
    left = F.when(small, F.raise_error(F.lit("canvas is too small")).cast("int")).otherwise(F.floor((F.lit(width) - width_of()) * ax / 2).cast("int"))
    top = F.floor((F.lit(height) - height_of()) * ay / 2).cast("int")
    return pad(df, top, F.lit(width) - width_of() - left, F.lit(height) - height_of() - top, left, color)


def center_on_canvas(df: DataFrame, width: int, height: int, color=(0, 0, 0, 0)) -> DataFrame:
    return align(df, width, height, "center", color)


pad_to_size = center_on_canvas


def pad_to_aspect(df: DataFrame, ratio: float, color=(0, 0, 0, 0)) -> DataFrame:
    same = F.abs(width_of() / height_of() - F.lit(float(ratio))) < 0.001
    wide = width_of() / height_of() > ratio
    width = F.when(same | wide, width_of()).otherwise(rounded(height_of() * F.lit(float(ratio))))
    height = F.when(wide & ~same, rounded(width_of() / F.lit(float(ratio)))).otherwise(height_of())
    left, top = F.floor((width - width_of()) / 2).cast("int"), F.floor((height - height_of()) / 2).cast("int")
    return pad(df, top, width - width_of() - left, height - height_of() - top, left, color)


def expand_canvas(df: DataFrame, amount: int, color=(0, 0, 0, 0)) -> DataFrame:
    return pad(df, amount, amount, amount, amount, color)


border = expand_canvas


def frame(df: DataFrame, mat: int, mat_color, outer: int, outer_color) -> DataFrame:
    return border(border(df, mat, mat_color), outer, outer_color)


def recenter(df: DataFrame, alpha_threshold: int = 0) -> DataFrame:
    """Moves what has alpha above a threshold to the middle; wholly transparent images stay."""
    df = bounds(df, _alpha(alpha_threshold))
    x0, y0 = F.coalesce("x0", F.lit(0)), F.coalesce("y0", F.lit(0))
    x1, y1 = F.coalesce("x1", width_of() - 1), F.coalesce("y1", height_of() - 1)
    dx = F.floor((width_of() - (x1 - x0 + 1)) / 2).cast("int") - x0
    dy = F.floor((height_of() - (y1 - y0 + 1)) / 2).cast("int") - y0
    box = F.struct(*(c.alias(n) for c, n in ((x0, "x0"), (x1, "x1"), (y0, "y0"), (y1, "y1"), (dx, "dx"), (dy, "dy"))))

    def source(x, y, k):
        sx, sy = x - k["dx"], y - k["dy"]
        return F.when((sx >= k["x0"]) & (sx <= k["x1"]) & (sy >= k["y0"]) & (sy <= k["y1"]), sx).otherwise(F.lit(-1)), sy

    return gather(df, width_of(), height_of(), source, known=box)


recenter_with_alpha_threshold = recenter


def resize(df: DataFrame, width, height, interpolation: str = BILINEAR) -> DataFrame:
    """The corners of the grids meet: source = target * (S - 1) / (D - 1)."""
    width, height = whole(width), whole(height)
    ratio = lambda s, d: F.when((d > 1) & (s > 1), (s - 1) / F.greatest(d - 1, F.lit(1))).otherwise(F.lit(0.0))
    rx, ry = ratio(width_of(), width), ratio(height_of(), height)
    return sample(df, width, height, lambda x, y: (F.least(x * rx, (width_of() - 1).cast("double")), F.least(y * ry, (height_of() - 1).cast("double"))), interpolation)


resize_exact = resize


def _scaled(v: Column, factor) -> Column:
    return F.greatest(F.lit(1), rounded(v * (factor if isinstance(factor, Column) else F.lit(float(factor)))))


def scale(df: DataFrame, factor: float, interpolation: str = BILINEAR) -> DataFrame:
    if not (math.isfinite(factor) and factor > 0):
        raise ValueError("factor must be positive")
    return resize(df, _scaled(width_of(), factor), _scaled(height_of(), factor), interpolation)


def resize_by_percent(df: DataFrame, percent: float, interpolation: str = BILINEAR) -> DataFrame:
    return scale(df, percent / 100.0, interpolation)


def resize_to_width(df: DataFrame, width: int, interpolation: str = BILINEAR) -> DataFrame:
    return resize(df, width, _scaled(height_of(), F.lit(float(width)) / width_of()), interpolation)


def resize_to_height(df: DataFrame, height: int, interpolation: str = BILINEAR) -> DataFrame:
    return resize(df, _scaled(width_of(), F.lit(float(height)) / height_of()), height, interpolation)


scale_width, scale_height = resize_to_width, resize_to_height


def resize_to_fit(df: DataFrame, width: int, height: int, interpolation: str = BILINEAR) -> DataFrame:
    """Into a box, with the aspect kept; never larger."""
    k = F.least(F.lit(float(width)) / width_of(), F.lit(float(height)) / height_of(), F.lit(1.0))
    return resize(df, _scaled(width_of(), k), _scaled(height_of(), k), interpolation)


resize_fit = downscale = resize_to_fit


def thumbnail(df: DataFrame, size: int, interpolation: str = BILINEAR) -> DataFrame:
    return resize_to_fit(df, size, size, interpolation)


def resize_fill(df: DataFrame, width: int, height: int, interpolation: str = BILINEAR) -> DataFrame:
    """Covers a box, then cuts its middle."""
    k = F.greatest(F.lit(float(width)) / width_of(), F.lit(float(height)) / height_of())
    cover = resize(df, F.greatest(F.lit(width), rounded(width_of() * k)), F.greatest(F.lit(height), rounded(height_of() * k)), interpolation)
    return crop_center(cover, width, height)


resize_cover = resize_fill


def upscale(df: DataFrame, width: int, height: int, interpolation: str = BILINEAR) -> DataFrame:
    """To at least a box, with the aspect kept, unless both sides are that long."""
    k = F.when((width_of() >= width) & (height_of() >= height), F.lit(1.0)).otherwise(F.greatest(F.lit(float(width)) / width_of(), F.lit(float(height)) / height_of()))
    return resize(df, _scaled(width_of(), k), _scaled(height_of(), k), interpolation)


def shear_horizontal(df: DataFrame, factor: float) -> DataFrame:
    """Row y moves by round(y * factor); the canvas grows by ceil(h * |factor|)."""
    grow = F.ceil(height_of() * F.lit(abs(float(factor)))).cast("int")
    base = grow if factor < 0 else F.lit(0)
    return gather(df, width_of() + grow, height_of(), lambda x, y: (x - base - _half_away(y * F.lit(float(factor))), y))


def shear_vertical(df: DataFrame, factor: float) -> DataFrame:
    grow = F.ceil(width_of() * F.lit(abs(float(factor)))).cast("int")
    base = grow if factor < 0 else F.lit(0)
    return gather(df, width_of(), height_of() + grow, lambda x, y: (x, y - base - _half_away(x * F.lit(float(factor)))))


def _half_away(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.abs(v) + F.lit(0.5))).cast("int")


def affine_transform(df: DataFrame, m: tuple[tuple[float, float, float], tuple[float, float, float]]) -> DataFrame:
    """A forward 2x3 matrix, inverted; bilinear on the same canvas."""
    (a, b, c), (d, e, f) = m
    det = a * e - b * d
    if abs(det) < 1e-10:
        raise ValueError("the matrix can't be inverted")
    return sample(df, width_of(), height_of(), lambda x, y: ((F.lit(e / det) * (x - F.lit(float(c))) - F.lit(b / det) * (y - F.lit(float(f)))), (F.lit(-d / det) * (x - F.lit(float(c))) + F.lit(a / det) * (y - F.lit(float(f))))))


def translate(df: DataFrame, dx: int, dy: int) -> DataFrame:
    return gather(df, width_of(), height_of(), lambda x, y: (x - dx, y - dy))


def homography(df: DataFrame, m, width: int, height: int) -> DataFrame:
    """A 3x3 matrix from output to source; bilinear."""
    (a, b, c), (d, e, f), (g, h, i) = ([float(v) for v in row] for row in m)

    def source(x, y):
        z = F.lit(g) * x + F.lit(h) * y + F.lit(i)
        z = F.when(F.abs(z) < 1e-10, F.lit(None)).otherwise(z)
        return (F.coalesce((F.lit(a) * x + F.lit(b) * y + F.lit(c)) / z, F.lit(-1.0)), F.coalesce((F.lit(d) * x + F.lit(e) * y + F.lit(f)) / z, F.lit(-1.0)))

    return sample(df, width, height, source)


def solve_homography(src, dst) -> list[list[float]]:
    """The matrix that takes the four dst points to the src points, by the direct linear transform."""
    import numpy as np

    rows, right = [], []
    for (x, y), (u, v) in zip(dst, src):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3).tolist()]


def perspective_transform(df: DataFrame, src, dst, width: int, height: int, compat: bool = False) -> DataFrame:
    """Takes the src points to the dst points; compat keeps the identity of engines that leave the solver out."""
    matrix = [[1, 0, 0], [0, 1, 0], [0, 0, 1]] if compat else solve_homography(src, dst)
    return homography(df, matrix, width, height)


def perspective_correct(df: DataFrame, corners, width: int, height: int, compat: bool = False) -> DataFrame:
    """Stretches a quadrilateral (top left, top right, bottom right, bottom left) over the frame."""
    target = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    return perspective_transform(df, corners, target, width, height, compat)
