"""Geometry over 8x8 luma images, and RGB ones where alpha or fill colours matter."""

from __future__ import annotations

import math

from .. import model
from ..operators import geometry as g
from . import query

OUT = ["image_id", "x", "y", "v"]


def add(name: str, sql: str, f, *args, source=model.gray8, **kwargs):
    @query(name, sql)
    def run(spark, sf_dir):
        return model.pixels(f(source(spark, sf_dir), *args, **kwargs)).select(*OUT)


def moved(x: str, y: str, where: str = "true", of: str = "{gray8}") -> str:
    return f"SELECT image_id, CAST({x} AS INTEGER) AS x, CAST({y} AS INTEGER) AS y, v FROM {of} WHERE {where}"


def grid(w: int, h: int, sx: str, sy: str, fill: int = 0) -> str:
    """Integer places sx, sy (of gx, gy) on a w x h canvas."""
    return f"SELECT i.image_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, coalesce(v, {fill}) AS v FROM (SELECT DISTINCT image_id FROM {{gray8}}) i CROSS JOIN (SELECT unnest(range({w})) AS gx) CROSS JOIN (SELECT unnest(range({h})) AS gy) LEFT JOIN {{gray8}} p ON p.image_id = i.image_id AND p.x = ({sx}) AND p.y = ({sy})"


def bilinear(w: int, h: int, sx: str, sy: str, size: int = 8) -> str:
    """Real places sx, sy (of gx, gy) on a w x h canvas, bilinear, 0 outside."""
    n = size - 1
    return f"""WITH o AS (SELECT gx, gy, {sx} AS sx, {sy} AS sy FROM (SELECT CAST(unnest(range({w})) AS DOUBLE) AS gx) CROSS JOIN (SELECT CAST(unnest(range({h})) AS DOUBLE) AS gy)),
t AS (SELECT gx, gy, sx, sy, floor(sx) AS fx, floor(sy) AS fy, sx - floor(sx) AS dx, sy - floor(sy) AS dy, sx >= 0 AND sy >= 0 AND sx <= {n} AND sy <= {n} AS ok FROM o),
k AS (SELECT gx, gy, ok, x, y, sum(wt) AS wt FROM (SELECT gx, gy, ok, least({n}, fx + ox) AS x, least({n}, fy + oy) AS y, (CASE ox WHEN 0 THEN 1 - dx ELSE dx END) * (CASE oy WHEN 0 THEN 1 - dy ELSE dy END) AS wt FROM t, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS c(ox, oy)) GROUP BY ALL)
SELECT i.image_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, CAST(coalesce(floor(sum(wt * v) FILTER (ok) + 0.5 + 1e-9), 0) AS INTEGER) AS v
FROM (SELECT DISTINCT image_id FROM {{gray8}}) i CROSS JOIN k LEFT JOIN {{gray8}} p ON p.image_id = i.image_id AND p.x = k.x AND p.y = k.y GROUP BY 1, 2, 3"""


add("flip_h", moved("7 - x", "y"), g.flip_horizontal)
add("flip_v", moved("x", "7 - y"), g.flip_vertical)
add("flip_both", moved("7 - x", "7 - y"), g.flip_both)
add("rot90", moved("7 - y", "x"), g.rotate_90)
add("rot180", moved("7 - x", "7 - y"), g.rotate_180)
add("rot270", moved("y", "7 - x"), g.rotate_270)
add("transpose", moved("y", "x"), g.transpose)
add("transverse", moved("7 - y", "7 - x"), g.transverse)
add("crop", moved("x - 2", "y - 1", "x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4"), g.crop, 2, 1, 5, 4)
add("crop_center", moved("x - 2", "y - 1", "x BETWEEN 2 AND 4 AND y BETWEEN 1 AND 6"), g.crop_center, 3, 6)
add("crop_to_aspect", moved("x", "y - 3", "y BETWEEN 3 AND 7"), g.crop_to_aspect, 1.6, "br")
add("crop_percentage", moved("x - 1", "y - 2", "x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6"), g.crop_percentage, 25, 25, 10, 10)
BOX = "(SELECT p.image_id, x, y, v, min(CASE WHEN {0} THEN x END) OVER i AS x0, max(CASE WHEN {0} THEN x END) OVER i AS x1, min(CASE WHEN {0} THEN y END) OVER i AS y0, max(CASE WHEN {0} THEN y END) OVER i AS y1 FROM (SELECT *, max(CASE WHEN x = 0 AND y = 0 THEN v END) OVER (PARTITION BY image_id) AS c FROM {{gray8}}) p WINDOW i AS (PARTITION BY p.image_id))"
AUTO = BOX.format("abs(v - c) > 60")
add("autocrop", f"SELECT image_id, CAST(x - coalesce(x0, 0) AS INTEGER) AS x, CAST(y - coalesce(y0, 0) AS INTEGER) AS y, v FROM {AUTO} WHERE x0 IS NULL OR (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)", g.autocrop, 60)
add("pad", grid(13, 10, "gx - 3", "gy", 9), g.pad, 0, 2, 2, 3, (9, 9, 9, 255))
add("pad_to_size", grid(11, 12, "gx - 1", "gy - 2", 7), g.pad_to_size, 11, 12, (7, 7, 7, 7))
add("pad_to_aspect", grid(12, 8, "gx - 2", "gy", 5), g.pad_to_aspect, 1.5, (5, 5, 5, 5))
add("expand_canvas", grid(12, 12, "gx - 2", "gy - 2", 1), g.expand_canvas, 2, (1, 1, 1, 1))
add("border", grid(10, 10, "gx - 1", "gy - 1", 200), g.border, 1, (200, 0, 0, 255))
add("frame", "SELECT image_id, x, y, CASE WHEN v = -1 THEN CASE WHEN x BETWEEN 1 AND 12 AND y BETWEEN 1 AND 12 THEN 3 ELSE 4 END ELSE v END AS v FROM (" + grid(14, 14, "gx - 3", "gy - 3", -1) + ")", g.frame, 2, (3, 3, 3, 3), 1, (4, 4, 4, 4))
add("align_9way", " UNION ALL ".join(f"({grid(9 + k, 10, f'gx - {((1 + k) * ax) // 2}', f'gy - {2 * ay // 2}', k)})" for k, (ax, ay) in enumerate(g.ANCHORS.values())), lambda df: _all([g.align(df, 9 + k, 10, a, (k, k, k, k)) for k, a in enumerate(g.ANCHORS)]))
add("translate", grid(8, 8, "gx - 2", "gy + 3"), g.translate, 2, -3)
add("shear_h", grid(12, 8, "gx - CAST(floor(gy * 0.5::DOUBLE + 0.5) AS BIGINT)", "gy"), g.shear_horizontal, 0.5)
add("shear_v", grid(8, 11, "gx", "gy - 3 + CAST(floor(gx * 0.3::DOUBLE + 0.5) AS BIGINT)"), g.shear_vertical, -0.3)
add("resize_nearest", grid(5, 12, "CAST(floor(gx * (7 / 4.0::DOUBLE) + 0.5) AS BIGINT)", "CAST(floor(gy * (7 / 11.0::DOUBLE) + 0.5) AS BIGINT)"), g.resize, 5, 12, g.NEAREST)
add("resize_bilinear", bilinear(11, 5, "least(7, gx * (7 / 10.0::DOUBLE))", "least(7, gy * (7 / 4.0::DOUBLE))"), g.resize, 11, 5)
add("resize_fit", bilinear(6, 6, "least(7, gx * (7 / 5.0::DOUBLE))", "least(7, gy * (7 / 5.0::DOUBLE))"), g.resize_to_fit, 20, 6)
add("thumbnail", bilinear(4, 4, "least(7, gx * (7 / 3.0::DOUBLE))", "least(7, gy * (7 / 3.0::DOUBLE))"), g.thumbnail, 4)
add("resize_fill", bilinear(10, 6, "least(7, gx * (7 / 9.0::DOUBLE))", "least(7, (gy + 2) * (7 / 9.0::DOUBLE))"), g.resize_fill, 10, 6)
add("scale", bilinear(12, 12, "least(7, gx * (7 / 11.0::DOUBLE))", "least(7, gy * (7 / 11.0::DOUBLE))"), g.scale, 1.5)
add("upscale", bilinear(16, 16, "least(7, gx * (7 / 15.0::DOUBLE))", "least(7, gy * (7 / 15.0::DOUBLE))"), g.upscale, 4, 16)
add("affine", bilinear(8, 8, "(gx - 1) / 1.25::DOUBLE", "(gy + 1) / 0.8::DOUBLE"), g.affine_transform, ((1.25, 0, 1), (0, 0.8, -1)))
add("homography", bilinear(8, 8, "(gx + 0.5) / (0.0625::DOUBLE * gx + 1)", "(gy + 0.25) / (0.0625::DOUBLE * gx + 1)"), g.homography, ((1, 0, 0.5), (0, 1, 0.25), (0.0625, 0, 1)), 8, 8)


def _rotated(angle: float, w: int, h: int, ex: float, ey: float) -> tuple[str, str]:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return f"({c!r}::DOUBLE * (gx + {-ex!r}::DOUBLE) + {s!r}::DOUBLE * (gy + {-ey!r}::DOUBLE) + 3.5::DOUBLE)", f"({-s!r}::DOUBLE * (gx + {-ex!r}::DOUBLE) + {c!r}::DOUBLE * (gy + {-ey!r}::DOUBLE) + 3.5::DOUBLE)"


E33 = (abs(math.cos(math.radians(33))) + abs(math.sin(math.radians(33)))) * 3.5
N33 = math.ceil(2 * E33) + 1
X33, Y33 = _rotated(33, N33, N33, E33, E33)
INSIDE = "CASE WHEN {0} >= 0 AND {0} <= 7 AND {1} >= 0 AND {1} <= 7 THEN CAST(floor({2} + 0.5) AS BIGINT) ELSE -1 END"
add("rotate_33_nearest", grid(N33, N33, INSIDE.format(X33, Y33, X33), INSIDE.format(X33, Y33, Y33)), g.rotate_bounded, 33, g.NEAREST)
X120, Y120 = _rotated(120, 8, 8, 3.5, 3.5)
add("rotate_120_bilinear", bilinear(8, 8, X120, Y120), g.rotate_cropped, 120)


def _all(frames):
    out = frames[0]
    for df in frames[1:]:
        out = out.unionAll(df)
    return out


def with_alpha(spark, sf_dir):
    """Luma with alpha: what is above 180 counts as content."""
    from pyspark.sql import functions as F

    df = model.gray8(spark, sf_dir)
    return df.withColumn("planes", F.array(F.col("planes")[0], F.transform(F.col("planes")[0], lambda v: F.when(v > 150, v).otherwise(F.lit(0)))))


ALPHA = BOX.format("v > 150")
add("crop_to_content", f"SELECT image_id, CAST(x - coalesce(x0, 0) AS INTEGER) AS x, CAST(y - coalesce(y0, 0) AS INTEGER) AS y, v FROM {ALPHA} WHERE x0 IS NULL OR (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)", g.crop_to_content, source=with_alpha)
add("recenter", f"SELECT g.image_id, g.x, g.y, coalesce(b.v, 0) AS v FROM {{gray8}} g LEFT JOIN (SELECT image_id, v, x + CASE WHEN x0 IS NULL THEN 0 ELSE (8 - (x1 - x0 + 1)) // 2 - x0 END AS nx, y + CASE WHEN x0 IS NULL THEN 0 ELSE (8 - (y1 - y0 + 1)) // 2 - y0 END AS ny FROM {ALPHA} WHERE x0 IS NULL OR (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)) b ON b.image_id = g.image_id AND nx = g.x AND ny = g.y", g.recenter, source=with_alpha)
