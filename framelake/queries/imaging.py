"""Neighbourhood operators and compositing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import composite as c
from ..operators import neighbourhood as n
from . import query

OUT = ["image_id", "x", "y", "v"]


def add(name: str, sql: str, f, source=model.gray8, places: int | None = None):
    @query(name, sql)
    def run(spark, sf_dir):
        df = model.pixels(f(source(spark, sf_dir))).select(*OUT)
        return df.withColumn("v", F.round("v", places)) if places else df


def conv(kernel: tuple[int, ...], size: int = 8) -> str:
    cells = ", ".join(f"({dx}, {dy}, {k})" for k, (dx, dy) in zip(kernel, n.AROUND))
    inner = f"a.x BETWEEN 1 AND {size - 2} AND a.y BETWEEN 1 AND {size - 2}"
    return f"SELECT a.image_id, a.x, a.y, CAST(CASE WHEN {inner} THEN floor(greatest(0, least(255, sum(k * coalesce(b.v, 0))))) ELSE 0 END AS INTEGER) AS v FROM {{gray8}} a CROSS JOIN (VALUES {cells}) AS o(dx, dy, k) LEFT JOIN {{gray8}} b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY a.image_id, a.x, a.y"


def clamped(agg: str, cells: str, of: str = "{gray8}", columns: str = "dx, dy") -> str:
    return f"SELECT a.image_id, a.x, a.y, {agg} AS v FROM {of} a CROSS JOIN (VALUES {cells}) AS o({columns}) JOIN {of} b ON b.image_id = a.image_id AND b.x = greatest(0, least(7, a.x + dx)) AND b.y = greatest(0, least(7, a.y + dy)) GROUP BY a.image_id, a.x, a.y"


NINE = ", ".join(f"({dx}, {dy})" for dx, dy in n.AROUND)


def blurred(sigma: float) -> str:
    cells = ", ".join(f"({dx}, {dy}, {wx * wy!r}::DOUBLE)" for dx, wx in n.gauss_weights(sigma) for dy, wy in n.gauss_weights(sigma))
    return clamped("CAST(floor(sum(k * b.v) + 0.5 + 1e-9) AS INTEGER)", cells, columns="dx, dy, k")


add("edge_detect", conv(n.EDGE), lambda df: n.edge_detect(df, 1.0))
add("emboss", conv(n.EMBOSS), lambda df: n.emboss(df, 2.0))
add("gaussian_blur", blurred(0.8), lambda df: n.gaussian_blur(df, 0.8))
add("unsharp_mask", f"SELECT a.image_id, a.x, a.y, CASE WHEN abs(a.v - b.v) > 5 THEN greatest(0, least(255, 2 * a.v - b.v)) ELSE a.v END AS v FROM {{gray8}} a JOIN ({blurred(0.8)}) b USING (image_id, x, y)", lambda df: n.unsharp_mask(df, 0.8, 5))
add("denoise", f"SELECT a.image_id, a.x, a.y, CAST(floor(a.v * k + b.v * (1 - k) + 0.5 + 1e-9) AS INTEGER) AS v FROM {{gray8}} a JOIN ({blurred(1.0)}) b USING (image_id, x, y) JOIN (SELECT image_id, x, y, least(1.0::DOUBLE, v / 9.0::DOUBLE / 12) AS k FROM ({clamped('sum(abs(b.v - a.v))', NINE)})) USING (image_id, x, y)", lambda df: n.denoise(df, 2))
add("deinterlace", "SELECT image_id, x, y, CAST(CASE WHEN y % 2 = 0 THEN v ELSE (coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v)) // 2 END AS INTEGER) AS v FROM {gray8} WINDOW c AS (PARTITION BY image_id, x ORDER BY y)", lambda df: n.deinterlace(df, 0))
add("dilate", clamped("max(b.v)", ", ".join(f"({dx}, {dy})" for dx in range(-2, 3) for dy in range(-2, 3))), lambda df: n.dilate(df, 2))
add("erode", clamped("min(b.v)", NINE), lambda df: n.erode(df, 1))
SOBEL_X, SOBEL_Y = (-1, 0, 1, -2, 0, 2, -1, 0, 1), (-1, -2, -1, 0, 0, 0, 1, 2, 1)
CELLS = ", ".join(f"({dx}, {dy}, {a}, {b})" for (dx, dy), a, b in zip(n.AROUND, SOBEL_X, SOBEL_Y))
add("sobel_edges", f"SELECT image_id, x, y, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND v > 50 THEN 255 ELSE 0 END AS v FROM ({clamped('floor(least(255, sqrt(CAST(sum(a1 * b.v) * sum(a1 * b.v) + sum(a2 * b.v) * sum(a2 * b.v) AS DOUBLE)) / 4))', CELLS, columns='dx, dy, a1, a2')})", n.sobel_edges)


def box(of: str, radius: int = 2, value: str = "v", extra: str = "") -> str:
    return f"SELECT a.image_id, a.x, a.y, avg(CAST(b.{value} AS DOUBLE)) AS {value}{extra} FROM {of} a JOIN {of} b ON b.image_id = a.image_id AND b.x BETWEEN a.x - {radius} AND a.x + {radius} AND b.y BETWEEN a.y - {radius} AND a.y + {radius} GROUP BY a.image_id, a.x, a.y"


add("box_mean", f"SELECT image_id, x, y, round(v, 6) AS v FROM ({box('{gray8}')})", lambda df: n.box_mean(df, 2), places=6)
GM = "(SELECT image_id, x, y, v / 255.0::DOUBLE AS i, CASE WHEN v > 128 THEN 1.0::DOUBLE ELSE 0 END AS p FROM {gray8})"
NEAR = "b.image_id = a.image_id AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2"


@query("guided_filter", f"""WITH q AS {GM},
m AS (SELECT a.image_id, a.x, a.y, avg(b.i) AS mi, avg(b.p) AS mp, avg(b.i * b.p) AS mip, avg(b.i * b.i) AS mii FROM q a JOIN q b ON {NEAR} GROUP BY 1, 2, 3),
k AS (SELECT image_id, x, y, (mip - mi * mp) / (mii - mi * mi + 0.01::DOUBLE) AS a, mp - (mip - mi * mp) / (mii - mi * mi + 0.01::DOUBLE) * mi AS b FROM m),
s AS (SELECT a.image_id, a.x, a.y, avg(b.a) AS a, avg(b.b) AS b FROM k a JOIN k b ON {NEAR} GROUP BY 1, 2, 3)
SELECT image_id, x, y, round(greatest(0, least(1, a * i + b)), 6) AS v FROM s JOIN q USING (image_id, x, y)""")
def guided_filter(spark, sf_dir):
    df = model.gray8(spark, sf_dir)
    v = F.col("planes")[0]
    df = df.withColumn("planes", F.array(F.transform(v, lambda x: x / F.lit(255.0)), F.transform(v, lambda x: F.when(x > 128, 1.0).otherwise(0.0))))
    return model.pixels(n.guided_filter(df, 2)).select("image_id", "x", "y", F.round("v", 6).alias("v"))


def pair(spark, sf_dir):
    """RGB images, and for each a 4x4 luma layer with alpha from its red plane."""
    base = model.rgb8(spark, sf_dir)
    part = lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get(F.col("planes")[k], F.floor(i / 4).cast("int") * 8 + i % 4))
    return base, base.select("image_id", F.lit(4).alias("w"), F.lit(4).alias("h"), F.array(part(0), part(1)).alias("planes"))


def composited(opacity: str) -> str:
    sa = f"(l.g / 255.0::DOUBLE * {opacity})"
    mix = lambda k: f"CAST(CASE WHEN l.g IS NULL THEN b.{k} ELSE floor((l.r * {sa} + b.{k} * (1 - {sa})) + 0.5 + 1e-9) END AS INTEGER) AS {k}"
    return f"SELECT b.image_id, b.x, b.y, {mix('r')}, {mix('g')}, {mix('b')} FROM {{rgb8}} b LEFT JOIN {{rgb8}} l ON l.image_id = b.image_id AND l.x = b.x - 3 AND l.y = b.y - 2 AND l.x < 4 AND l.y < 4"


@query("overlay", composited("1"))
def overlay(spark, sf_dir):
    return model.pixels(c.overlay(*pair(spark, sf_dir), 3, 2), "r", "g", "b").select("image_id", "x", "y", "r", "g", "b")


@query("watermark", composited("0.5::DOUBLE"))
def watermark(spark, sf_dir):
    return model.pixels(c.watermark(*pair(spark, sf_dir), 3, 2, 0.5), "r", "g", "b").select("image_id", "x", "y", "r", "g", "b")


add("mask_regions", "SELECT image_id, x, y, CASE WHEN (x >= 1 AND x < 4 AND y >= 0 AND y < 2) OR (x - 5) * (x - 5) + (y - 5) * (y - 5) <= 5 THEN 255 ELSE 0 END AS v FROM {gray8}", lambda df: c.create_mask(df, [(1, 0, 3, 2)], [(5, 5, 2.23606797749979)]))
R = "CAST(floor(least(10, abs(a.x / 7.0::DOUBLE - 0.5) * 6 + 1e-9)) AS BIGINT)"
add("depth_blur", f"SELECT a.image_id, a.x, a.y, CAST(sum(b.v) // count(*) AS INTEGER) AS v FROM {{gray8}} a JOIN {{gray8}} b ON b.image_id = a.image_id AND abs(b.x - a.x) <= {R} AND abs(b.y - a.y) <= {R} GROUP BY a.image_id, a.x, a.y", lambda df: c.depth_blur(df, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 8 / F.lit(7.0)), 0.5, 6))


@query("subtitle_burn_in", """WITH f AS (SELECT image_id, image_id % 40 AS t, x, y, v FROM {gray8}), u AS (SELECT * FROM {cue} WHERE track_id = 0)
SELECT f.image_id, f.x, f.y, CASE WHEN text IS NOT NULL AND abs(x - 4) <= length(text) * 0.4::DOUBLE * 0.55 / 2 AND abs(y - 7.2::DOUBLE) <= 0.2 THEN 255 ELSE v END AS v FROM f LEFT JOIN u ON t >= "start" AND t < "end" """)
def subtitle_burn_in(spark, sf_dir):
    frames = model.gray8(spark, sf_dir).withColumn("t", F.col("image_id") % 40)
    track = model.cues(spark, sf_dir).where("track_id = 0").select("start", "end", "text")
    return model.pixels(c.subtitle_box(frames, track)).select(*OUT)
