"""Documents, colour maps and crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import colormaps
from ..operators import document as d
from . import query

OUT = ["image_id", "x", "y", "v"]
EDGE = "(SELECT *, min(CASE WHEN v < 250 THEN x END) OVER i AS x0, max(CASE WHEN v < 250 THEN x END) OVER i AS x1, min(CASE WHEN v < 250 THEN y END) OVER i AS y0, max(CASE WHEN v < 250 THEN y END) OVER i AS y1 FROM (SELECT image_id, x, y, CASE WHEN x < 5 OR y > 27 OR v > 150 THEN 255 ELSE v END AS v FROM {gray32}) WINDOW i AS (PARTITION BY image_id))"


def paper(spark, sf_dir):
    """32x32 scans: white to the left, below and where they are light."""
    light = F.transform(F.col("planes")[0], lambda v, i: F.when((i % 32 < 5) | (F.floor(i / 32) > 27) | (v > 150), 255).otherwise(v))
    return model.gray32(spark, sf_dir).withColumn("planes", F.array(light))


@query("remove_borders", f"SELECT image_id, CAST(x - greatest(0, x0 - 2) AS INTEGER) AS x, CAST(y - greatest(0, y0 - 2) AS INTEGER) AS y, v FROM {EDGE} WHERE x BETWEEN greatest(0, x0 - 2) AND x1 + 2 AND y BETWEEN greatest(0, y0 - 2) AND y1 + 2")
def remove_borders(spark, sf_dir):
    return model.pixels(d.remove_borders(paper(spark, sf_dir), 2)).select(*OUT)


@query("enhance_for_ocr", "WITH s AS (SELECT image_id, x, y, CAST(floor((v - min(v) OVER i) / CAST(max(v) OVER i - min(v) OVER i AS DOUBLE) * 255 + 1e-9) AS INTEGER) AS v FROM {gray8} WINDOW i AS (PARTITION BY image_id)) SELECT image_id, x, y, CAST(CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN greatest(0, least(255, 5 * v - lag(v) OVER r - lead(v) OVER r - lag(v) OVER c - lead(v) OVER c)) ELSE v END AS INTEGER) AS v FROM s WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)")
def enhance_for_ocr(spark, sf_dir):
    return model.pixels(d.enhance(model.gray8(spark, sf_dir))).select(*OUT)


@query("process_document")
def process_document(spark, sf_dir):
    return model.pixels(d.process(paper(spark, sf_dir))).select(*OUT)


RUNS = "(SELECT image_id, y, run, min(x) AS start, count(*) AS n, bool_or(dark) AS dark FROM (SELECT *, sum(turn) OVER w AS run FROM (SELECT image_id, x, y, v < 128 AS dark, CASE WHEN (v < 128) = lag(v < 128) OVER w THEN 0 ELSE 1 END AS turn FROM {gray32} WINDOW w AS (PARTITION BY image_id, y ORDER BY x)) WINDOW w AS (PARTITION BY image_id, y ORDER BY x)) GROUP BY 1, 2, 3)"


@query("finder_patterns", f"SELECT image_id, CAST(m + n2 // 2 AS INTEGER) AS x, y FROM (SELECT *, (n + n1 + n2 + n3 + n4) / 7.0::DOUBLE AS k FROM (SELECT *, lead(n, 1) OVER w AS n1, lead(n, 2) OVER w AS n2, lead(n, 3) OVER w AS n3, lead(n, 4) OVER w AS n4, lead(start, 2) OVER w AS m FROM {RUNS} WINDOW w AS (PARTITION BY image_id, y ORDER BY run))) WHERE dark AND n4 IS NOT NULL AND abs(n - k) <= k * 0.5 AND abs(n1 - k) <= k * 0.5 AND abs(n2 - 3 * k) <= k * 1.5 AND abs(n3 - k) <= k * 0.5 AND abs(n4 - k) <= k * 0.5")
def finder_patterns(spark, sf_dir):
    return d.finder_patterns(model.pixels(model.gray32(spark, sf_dir)))


@query("crop_boxes", "SELECT image_id, k AS det_id, CAST(x - k AS INTEGER) AS x, CAST(y - 1 AS INTEGER) AS y, v FROM {gray8}, (VALUES (1), (2)) AS c(k) WHERE x >= k AND x < k + 3 AND y BETWEEN 1 AND 5")
def crop_boxes(spark, sf_dir):
    df = model.gray8(spark, sf_dir)
    boxes = df.select("image_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("det_id"))
    boxes = boxes.select("image_id", "det_id", F.col("det_id").cast("double").alias("x1"), F.lit(2.0).alias("y1"), (F.col("det_id") + 3.0).alias("x2"), F.lit(5.0).alias("y2"))
    out = d.crop_boxes(df, boxes.withColumn("y1", F.lit(1.0)).withColumn("y2", F.lit(6.0)))
    px = model.pixels(out.withColumn("image_id", F.struct("image_id", "det_id")))
    return px.select("image_id.image_id", "image_id.det_id", "x", "y", "v")


@query("chroma_420", "SELECT image_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, CAST(floor(128 - 0.169::DOUBLE * (sum(r) // 4) - 0.331::DOUBLE * (sum(g) // 4) + 0.5 * (sum(b) // 4) + 1e-9) AS INTEGER) AS u, CAST(floor(128 + 0.5 * (sum(r) // 4) - 0.419::DOUBLE * (sum(g) // 4) - 0.081::DOUBLE * (sum(b) // 4) + 1e-9) AS INTEGER) AS v FROM {rgb8} GROUP BY image_id, x // 2, y // 2")
def chroma_420(spark, sf_dir):
    return d.chroma_420(model.pixels(model.rgb8(spark, sf_dir), "r", "g", "b"))


T = "(v / 255.0::DOUBLE)"
CUT = "CAST(floor(greatest(0, least(1, {0})) * 255 + 1e-9) AS INTEGER)"
CUBICS = {name: [CUT.format(f"{a}::DOUBLE + {b}::DOUBLE * {T} + {c}::DOUBLE * {T} * {T} + {e}::DOUBLE * {T} * {T} * {T}") for a, b, c, e in rows] for name, rows in colormaps.CUBIC.items()}
JET = [CUT.format(e) for e in (f"CASE WHEN {T} < 0.375 THEN 0 WHEN {T} < 0.625 THEN ({T} - 0.375) * 4 WHEN {T} < 0.875 THEN 1 ELSE 1 - ({T} - 0.875) * 4 END", f"CASE WHEN {T} < 0.125 THEN 0 WHEN {T} < 0.375 THEN ({T} - 0.125) * 4 WHEN {T} < 0.625 THEN 1 WHEN {T} < 0.875 THEN 1 - ({T} - 0.625) * 4 ELSE 0 END", f"CASE WHEN {T} < 0.125 THEN 0.5 + {T} * 4 WHEN {T} < 0.375 THEN 1 WHEN {T} < 0.625 THEN 1 - ({T} - 0.375) * 4 ELSE 0 END")]


@query("colormaps", " UNION ALL ".join(f"SELECT image_id, x, y, '{name}' AS map, {r} AS r, {g} AS g, {b} AS b FROM {{gray8}}" for name, (r, g, b) in {**CUBICS, "jet": JET}.items()))
def colormap(spark, sf_dir):
    px = model.pixels(model.gray8(spark, sf_dir))
    maps = F.explode(F.array(*(F.struct(F.lit(n).alias("map"), colormaps.colormap(F.col("v") / 255.0, n).alias("c")) for n in ("viridis", "plasma", "jet"))))
    return px.select("image_id", "x", "y", maps.alias("m")).select("image_id", "x", "y", "m.map", "m.c.*")
