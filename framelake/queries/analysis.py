"""Aggregates over images: histograms, thresholds, quality, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import color
from ..operators import analysis as a
from ..operators import geometry, pixels
from . import query


def gray(spark, sf_dir):
    return model.pixels(model.gray8(spark, sf_dir))


def gray32(spark, sf_dir):
    return model.pixels(model.gray32(spark, sf_dir))


def rgb(spark, sf_dir):
    return model.pixels(model.rgb8(spark, sf_dir), "r", "g", "b")


@query("image_info", "SELECT image_id, 8 AS w, 8 AS h, 'Rgb8' AS color_type, 3 AS channels, false AS has_alpha FROM {rgb8} GROUP BY image_id")
def image_info(spark, sf_dir):
    return a.image_info(model.rgb8(spark, sf_dir))


@query("histogram", "SELECT image_id, channel, bin, count(*) AS n FROM (SELECT image_id, 'r' AS channel, r AS bin FROM {rgb8} UNION ALL SELECT image_id, 'g', g FROM {rgb8} UNION ALL SELECT image_id, 'b', b FROM {rgb8}) GROUP BY ALL")
def histogram(spark, sf_dir):
    return a.histogram(rgb(spark, sf_dir), "r", "g", "b")


@query("contrast_histogram", "SELECT image_id, 'v' AS channel, CAST(floor(greatest(0, least(255, (v - 128) * (259.0::DOUBLE*306/(255*208.0::DOUBLE)) + 128)) + 0.5) AS INTEGER) AS bin, count(*) AS n FROM {gray8} GROUP BY ALL")
def contrast_histogram(spark, sf_dir):
    return a.histogram(pixels.adjust(gray(spark, sf_dir), color.contrast, 20))


CUM = "(SELECT image_id, v AS bin, n, sum(n) OVER w AS wb, sum(n * v) OVER w AS sb, sum(n) OVER i AS total, sum(n * v) OVER i AS s FROM (SELECT image_id, v, count(*) AS n FROM {gray8} GROUP BY ALL) WINDOW w AS (PARTITION BY image_id ORDER BY v), i AS (PARTITION BY image_id))"
OTSU = f"SELECT image_id, CAST(CASE WHEN max(k) > 0 THEN arg_max(bin, (k, -bin)) ELSE 0 END AS INTEGER) AS threshold FROM (SELECT image_id, bin, CASE WHEN total = wb THEN 0 ELSE round(CAST(wb AS DOUBLE) * (total - wb) * pow(sb / CAST(wb AS DOUBLE) - (s - sb) / CAST(total - wb AS DOUBLE), 2), 3) END AS k FROM {CUM}) GROUP BY image_id"


@query("otsu", OTSU)
def otsu(spark, sf_dir):
    return a.otsu(a.histogram(gray(spark, sf_dir)))


def tone_sql(of: str) -> str:
    return f"SELECT image_id, round(-sum(p * log2(p)), 6) AS entropy, min(CASE WHEN up >= total // 2 THEN bin END) AS median_brightness, min(bin) AS low, max(bin) AS high, round(sum(p * bin), 6) AS mean, round(sqrt(greatest(0, sum(p * bin * bin) - sum(p * bin) * sum(p * bin))), 6) AS deviation FROM (SELECT image_id, v AS bin, n / CAST(sum(n) OVER i AS DOUBLE) AS p, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS up, CAST(sum(n) OVER i AS BIGINT) AS total FROM (SELECT image_id, v, count(*) AS n FROM {of} GROUP BY ALL) WINDOW i AS (PARTITION BY image_id)) GROUP BY image_id"


@query("tone", tone_sql("{gray8}"))
def tone(spark, sf_dir):
    return a.tone(a.histogram(gray(spark, sf_dir)))


def near_sql(of: str) -> str:
    return f"(SELECT image_id, x, y, v, lag(v) OVER r AS lf, lead(v) OVER r AS rt, lag(v) OVER c AS up, lead(v) OVER c AS dn FROM {of} WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"


def laplacian_sql(of: str) -> str:
    return f"SELECT image_id, round(coalesce(avg(CAST(pow(lf + rt + up + dn - 4 * v, 2) AS DOUBLE)), 0), 6) AS laplacian FROM {near_sql(of)} GROUP BY image_id"


def density_sql(of: str, size: int) -> str:
    return f"SELECT image_id, round(count(*) FILTER ((abs(v - rt) > 30 OR abs(v - dn) > 30) AND x BETWEEN 1 AND {size - 2} AND y BETWEEN 1 AND {size - 2}) / CAST({(size - 2) ** 2} AS DOUBLE), 6) AS edge_density FROM {near_sql(of)} GROUP BY image_id"


def noise_sql(of: str, size: int) -> str:
    return f"SELECT image_id, round(CASE WHEN min(CASE WHEN bx * 8 < {size - 8} AND b2 * 8 < {size - 8} THEN k END) IS NULL THEN 100 ELSE least(100, sqrt(greatest(0, min(CASE WHEN bx * 8 < {size - 8} AND b2 * 8 < {size - 8} THEN k END))) * 10) END, 6) AS noise FROM (SELECT image_id, x // 8 AS bx, y // 8 AS b2, avg(v * v) - avg(v) * avg(v) AS k FROM {of} GROUP BY ALL) GROUP BY image_id"


def artifacts_sql(of: str, size: int) -> str:
    part = lambda op: f"((sum(abs(v - lf)) FILTER (x % 8 {op} 0) + sum(abs(v - up)) FILTER (y % 8 {op} 0)) / CAST(count(lf) FILTER (x % 8 {op} 0) + count(up) FILTER (y % 8 {op} 0) AS DOUBLE))"
    return f"SELECT image_id, coalesce({str(size >= 32).lower()} AND {part('=')} > {part('<>')} * 1.3::DOUBLE, false) AS artifacts FROM {near_sql(of)} GROUP BY image_id"


@query("laplacian_ms", laplacian_sql("{gray8}"))
def laplacian_ms(spark, sf_dir):
    return a.laplacian(model.gray8(spark, sf_dir))


@query("edge_density", density_sql("{gray8}", 8))
def edge_density(spark, sf_dir):
    return a.edge_density(model.gray8(spark, sf_dir))


@query("noise_blocks", noise_sql("{gray32}", 32))
def noise_blocks(spark, sf_dir):
    return a.noise(gray32(spark, sf_dir))


@query("artifacts", artifacts_sql("{gray32}", 32))
def artifacts(spark, sf_dir):
    return a.artifacts(model.gray32(spark, sf_dir))


HUE = "(SELECT *, greatest(r, g, b) AS t, CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) AS d FROM {rgb8})"
BIN = f"(SELECT image_id, CASE WHEN t > 0 THEN d / t ELSE 0 END AS sat, CASE WHEN d > 0 THEN floor(CASE WHEN k < 0 THEN k + 360 ELSE k END + 1e-9) END AS hue FROM (SELECT *, CASE WHEN d = 0 THEN NULL WHEN r = t THEN (g - b) / d WHEN g = t THEN 2 + (b - r) / d ELSE 4 + (r - g) / d END * 60 AS k FROM {HUE}))"
COLOR = f"SELECT image_id, round(sum(s) / sum(n) * 100, 6) AS saturation, round(least(100, coalesce(-sum(p * log2(p)), 0) / 8.5::DOUBLE * 100), 6) AS hue_variety FROM (SELECT *, CASE WHEN hue IS NOT NULL THEN n / CAST(sum(n) FILTER (hue IS NOT NULL) OVER (PARTITION BY image_id) AS DOUBLE) END AS p FROM (SELECT image_id, hue, count(*) AS n, sum(sat) AS s FROM {BIN} GROUP BY ALL)) GROUP BY image_id"
CAST_SQL = "SELECT image_id, CASE WHEN r - m > 15 THEN 'red' WHEN g - m > 15 THEN 'green' WHEN b - m > 15 THEN 'blue' WHEN m - b > 15 THEN 'yellow' WHEN m - r > 15 THEN 'cool/blue' END AS color_cast FROM (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b, (avg(r) + avg(g) + avg(b)) / 3 AS m FROM {rgb8} GROUP BY image_id)"


@query("color_metrics", COLOR)
def color_metrics(spark, sf_dir):
    return a.color_metrics(rgb(spark, sf_dir))


@query("color_cast", CAST_SQL)
def color_cast(spark, sf_dir):
    return a.color_cast(rgb(spark, sf_dir))


LUMA8 = "(SELECT image_id, x, y, CAST(floor(0.2126::DOUBLE*r + 0.7152::DOUBLE*g + 0.0722::DOUBLE*b + 0.5) AS INTEGER) AS v FROM {rgb8})"
QUALITY = f"""WITH t AS ({tone_sql(LUMA8)}), l AS ({laplacian_sql(LUMA8)}), n AS ({noise_sql(LUMA8, 8)}), c AS ({COLOR}), k AS ({CAST_SQL}),
m AS (SELECT image_id, color_cast, noise, saturation,
  CASE WHEN laplacian < 100 THEN laplacian * 0.3 WHEN laplacian < 500 THEN 30 + 40 * (laplacian - 100) / 400 WHEN laplacian < 2000 THEN 70 + 30 * (laplacian - 500) / 1500 ELSE 100 END AS sharpness,
  mean / 255 * 100 AS exposure,
  (least(100, deviation / 80 * 100) + greatest(high - greatest(low, 1), 0) / 255.0::DOUBLE * 100) / 2 AS contrast,
  (saturation + hue_variety) / 2 AS color
  FROM t JOIN l USING (image_id) JOIN n USING (image_id) JOIN c USING (image_id) JOIN k USING (image_id)),
s AS (SELECT *, greatest(0, least(100, 0.30::DOUBLE * sharpness + 0.20::DOUBLE * (100 - noise) + 0.20::DOUBLE * greatest(0, 100 - 2 * abs(exposure - 50)) + 0.15::DOUBLE * contrast + 0.15::DOUBLE * color)) AS score FROM m)
SELECT image_id, round(sharpness, 4) AS sharpness, round(noise, 4) AS noise, round(exposure, 4) AS exposure, round(contrast, 4) AS contrast, round(color, 4) AS color, round(score, 4) AS score,
  CASE WHEN round(score, 4) >= 85 THEN 'A' WHEN round(score, 4) >= 70 THEN 'B' WHEN round(score, 4) >= 50 THEN 'C' WHEN round(score, 4) >= 25 THEN 'D' ELSE 'F' END AS grade,
  concat_ws(',', CASE WHEN sharpness < 40 THEN 'blurry' END, CASE WHEN noise > 60 THEN 'noisy' END, CASE WHEN exposure > 80 THEN 'overexposed' END, CASE WHEN exposure < 20 THEN 'underexposed' END, CASE WHEN contrast < 30 THEN 'low_contrast' END, CASE WHEN saturation > 85 THEN 'oversaturated' END, CASE WHEN saturation < 15 THEN 'desaturated' END, CASE WHEN color_cast IS NOT NULL THEN 'color_cast' END, 'low_resolution') AS issues
FROM s"""


@query("quality_report", QUALITY)
def quality_report(spark, sf_dir):
    return a.quality(model.rgb8(spark, sf_dir))


@query("quality_rank", f"SELECT image_id, score, row_number() OVER (ORDER BY score DESC, image_id) AS place FROM ({QUALITY})")
def quality_rank(spark, sf_dir):
    return a.rank(quality_report(spark, sf_dir)).select("image_id", "score", "place")


@query("best_image", f"SELECT image_id, score, grade FROM ({QUALITY}) ORDER BY score DESC, image_id LIMIT 3")
def best_image(spark, sf_dir):
    return a.best(quality_report(spark, sf_dir), 3).select("image_id", "score", "grade")


@query("acceptable", f"SELECT image_id, score FROM ({QUALITY}) WHERE score >= 50")
def acceptable(spark, sf_dir):
    return quality_report(spark, sf_dir).where("score >= 50").select("image_id", "score")


SHIFTED = "(SELECT image_id, x, y, least(255, r + 9) AS r, g, 255 - b AS b FROM {rgb8})"


@query("compare_images", f"SELECT image_id, round(mse, 6) AS mse, round(CASE WHEN mse > 0 THEN 10 * log10(65025.0::DOUBLE / mse) END, 6) AS psnr, differing, max_delta FROM (SELECT a.image_id, sum(pow(a.r - s.r, 2) + pow(a.g - s.g, 2) + pow(a.b - s.b, 2)) / CAST(count(*) * 3 AS DOUBLE) AS mse, count(*) FILTER (a.r <> s.r OR a.g <> s.g OR a.b <> s.b) AS differing, max(greatest(abs(a.r - s.r), abs(a.g - s.g), abs(a.b - s.b))) AS max_delta FROM {{rgb8}} a JOIN {SHIFTED} s USING (image_id, x, y) GROUP BY a.image_id)")
def compare_images(spark, sf_dir):
    df = model.rgb8(spark, sf_dir)
    p = F.col("planes")
    return a.compare(df, df.withColumn("planes", F.array(F.transform(p[0], lambda v: F.least(F.lit(255), v + 9)), p[1], F.transform(p[2], lambda v: F.lit(255) - v))))


@query("ssim_flipped", "SELECT image_id, round(((2 * ma * mb + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE)) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE)), 6) AS ssim FROM (SELECT a.image_id, avg(a.v) AS ma, avg(b.v) AS mb, var_samp(a.v) AS va, var_samp(b.v) AS vb, covar_samp(a.v, b.v) AS cov FROM {gray8} a JOIN {gray8} b ON a.image_id = b.image_id AND a.x = 7 - b.x AND a.y = b.y GROUP BY a.image_id)")
def ssim_flipped(spark, sf_dir):
    df = model.gray8(spark, sf_dir)
    return a.global_ssim(df, geometry.flip_horizontal(df))


@query("adaptive_binarize", f"SELECT a.image_id, a.x, a.y, CASE WHEN a.v > greatest(0, (CAST(floor(avg(b.v) + 1e-9) AS BIGINT) + any_value(threshold)) // 2 - 5) THEN 255 ELSE 0 END AS v FROM {{gray8}} a JOIN {{gray8}} b ON b.image_id = a.image_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 JOIN ({OTSU}) o ON o.image_id = a.image_id GROUP BY a.image_id, a.x, a.y, a.v")
def adaptive_binarize(spark, sf_dir):
    df = model.gray8(spark, sf_dir)
    return model.pixels(a.adaptive_binarize(df, a.otsu(a.histogram(model.pixels(df))), 5)).select("image_id", "x", "y", "v")


@query("content_bbox", "SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {gray8} WHERE v > 200 GROUP BY image_id")
def content_bbox(spark, sf_dir):
    return gray(spark, sf_dir).where("v > 200").groupBy("image_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("scene_change", "SELECT image_id AS frame_no, round(d, 6) AS difference, d > 0.1 AS scene_change FROM (SELECT image_id, (abs(r - lag(r) OVER w) + abs(g - lag(g) OVER w) + abs(b - lag(b) OVER w)) / 3.0::DOUBLE / 255 AS d FROM {rgb8} WHERE x = 0 AND y = 0 WINDOW w AS (ORDER BY image_id)) WHERE d IS NOT NULL")
def scene_change(spark, sf_dir):
    return a.scene_changes(model.rgb8(spark, sf_dir).withColumnRenamed("image_id", "frame_no"), 0.1)


@query("skew_hough", "WITH e AS (SELECT image_id, x, y FROM {gray32} WHERE v > 200), l AS (SELECT image_id, theta, CAST(floor(y * cos(radians(CAST(theta AS DOUBLE))) - x * sin(radians(CAST(theta AS DOUBLE))) + 0.5 + 1e-9) AS INTEGER) AS rho, count(*) AS n FROM e, (SELECT unnest(range(-90, 90)) AS theta) GROUP BY ALL) SELECT image_id, CAST(arg_max(theta, (n, -abs(theta), -theta)) AS INTEGER) AS angle, max(n) AS votes, round(max(n) / CAST((SELECT count(*) FROM e WHERE e.image_id = l.image_id) AS DOUBLE), 6) AS confidence FROM l GROUP BY image_id")
def skew_hough(spark, sf_dir):
    return a.skew_angle(model.gray32(spark, sf_dir), 200)
