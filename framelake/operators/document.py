"""Scanned documents: borders, stretching and sharpening, binarisation, deskewing, finder patterns, crops of detections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import analysis, geometry, neighbourhood
from ..functions.binding import let
from ..model import pixels

#: What is darker than this is content; a smaller rest is no crop.
PAPER, LEAST = 250, 10


def content_box(df: DataFrame, margin: int) -> DataFrame:
    """Adds left, top, right, bottom of the content of luma images, with a margin, or the whole image."""
    df = geometry.bounds(df, lambda planes, i: F.get(planes[0], i) < PAPER)
    w, h = F.col("w"), F.col("h")
    return df.withColumns({
        "left": F.coalesce(F.greatest(F.lit(0), F.col("x0") - margin), F.lit(0)),
        "top": F.coalesce(F.greatest(F.lit(0), F.col("y0") - margin), F.lit(0)),
        "right": F.coalesce(F.least(w, F.col("x1") + 1 + margin), w),
        "bottom": F.coalesce(F.least(h, F.col("y1") + 1 + margin), h),
    })


def remove_borders(df: DataFrame, margin: int = 10) -> DataFrame:
    """Cuts paper around the content, unless ten pixels or fewer would be left of a side."""
    df = content_box(df, margin)
    ok = (F.col("right") - F.col("left") > LEAST) & (F.col("bottom") - F.col("top") > LEAST)
    pick = lambda a, b: F.when(ok, a).otherwise(b)
    return geometry.crop(df, pick(F.col("left"), F.lit(0)), pick(F.col("top"), F.lit(0)), pick(F.col("right") - F.col("left"), F.col("w")), pick(F.col("bottom") - F.col("top"), F.col("h")))


def enhance(df: DataFrame) -> DataFrame:
    """Luma stretched to 0..255, cut, then sharpened by 5 c - up - down - left - right inside the border."""
    bounds = F.struct(F.array_min(F.col("planes")[0]).alias("low"), F.array_max(F.col("planes")[0]).alias("high"))
    stretched = let(bounds, lambda b: F.transform(F.col("planes")[0], lambda v: F.when(b["high"] > b["low"], F.floor((v - b["low"]) / (b["high"] - b["low"]) * 255.0 + F.lit(1e-9)).cast("int")).otherwise(v)))
    df = df.withColumn("planes", F.array(stretched))

    def value(v: Column, i: Column, tap) -> Column:
        sharp = 5 * v - tap(0, -1) - tap(0, 1) - tap(-1, 0) - tap(1, 0)
        return F.when(neighbourhood.inside(i), F.greatest(F.lit(0), F.least(F.lit(255), sharp))).otherwise(v)

    return neighbourhood.per_pixel(df, value)


def deskew(df: DataFrame, angles: DataFrame, least: float = 0.3) -> DataFrame:
    """Turns each image by its own found angle (image_id, angle, confidence), where that is sure enough."""
    turn = F.when((F.col("confidence") >= least) & (F.col("angle") != 0), F.radians(-F.col("angle").cast("double"))).otherwise(F.lit(0.0))
    rows = df.join(angles, "image_id", "left").withColumn("turn", F.coalesce(turn, F.lit(0.0)))
    cx, cy = (F.col("w") - 1) / 2.0, (F.col("h") - 1) / 2.0
    cos, sin = F.cos("turn"), F.sin("turn")
    return geometry.sample(rows, F.col("w"), F.col("h"), lambda x, y: (cos * (x - cx) + sin * (y - cy) + cx, -sin * (x - cx) + cos * (y - cy) + cy))


@dataclass(frozen=True)
class DocumentConfig:
    deskew: bool = True
    margin: int = 10
    block: int = 31
    binarize: bool = True
    enhance: bool = True

    @classmethod
    def for_ocr(cls) -> DocumentConfig:
        return cls()

    @classmethod
    def for_photo(cls) -> DocumentConfig:
        return cls(margin=20, binarize=False)

    @classmethod
    def deskew_only(cls) -> DocumentConfig:
        return cls(binarize=False, enhance=False, margin=-1)


def process(df: DataFrame, config: DocumentConfig | None = None) -> DataFrame:
    """Luma scans through deskewing, border removal, binarisation and enhancement, as far as the settings ask."""
    config = config or DocumentConfig()
    if config.deskew:
        df = deskew(df, analysis.skew_angle(neighbourhood.sobel_edges(df)).select("image_id", "angle", "confidence"))
    if config.margin >= 0:
        df = remove_borders(df, config.margin)
    if config.binarize:
        df = analysis.adaptive_binarize(df, analysis.otsu(analysis.histogram(pixels(df))), config.block)
    return enhance(df) if config.enhance else df


def finder_patterns(px: DataFrame, threshold: int = 128) -> DataFrame:
    """Places (image_id, x, y) where dark and light runs of a row stand as 1:1:3:1:1, within half a module."""
    row = W.partitionBy("image_id", "y").orderBy("x")
    rows = px.withColumn("dark", F.col("v") < threshold)
    rows = rows.withColumn("turn", F.coalesce((F.col("dark") != F.lag("dark").over(row)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("turn").over(row))
    runs = rows.groupBy("image_id", "y", "run").agg(F.min("x").alias("start"), F.count(F.lit(1)).alias("n"), F.first("dark").alias("dark"))
    line = W.partitionBy("image_id", "y").orderBy("run")
    five = [F.col("n"), *(F.lead("n", k).over(line) for k in range(1, 5))]
    runs = runs.withColumns({f"n{k}": c for k, c in enumerate(five)}).withColumn("middle", F.lead("start", 2).over(line)).where("dark and n4 is not null")
    module = sum((F.col(f"n{k}") for k in range(1, 5)), F.col("n0")) / 7.0
    ok = F.lit(True)
    for k, want in enumerate((1, 1, 3, 1, 1)):
        ok = ok & (F.abs(F.col(f"n{k}") - want * module) <= module * (0.5 * want))
    return runs.where(ok).select("image_id", (F.col("middle") + F.floor(F.col("n2") / 2)).cast("int").alias("x"), "y")


def crop_boxes(df: DataFrame, boxes: DataFrame, padding: float = 0.0) -> DataFrame:
    """A crop of its image for each box (image_id, det_id, x1, y1, x2, y2), padded by a share of its size and clipped."""
    rows = df.join(boxes.select("image_id", "det_id", "x1", "y1", "x2", "y2"), "image_id")
    px, py = (F.col("x2") - F.col("x1")) * padding, (F.col("y2") - F.col("y1")) * padding
    left, top = F.floor(F.greatest(F.lit(0.0), F.col("x1") - px)).cast("int"), F.floor(F.greatest(F.lit(0.0), F.col("y1") - py)).cast("int")
    right, bottom = F.floor(F.least(F.col("w").cast("double"), F.col("x2") + px)).cast("int"), F.floor(F.least(F.col("h").cast("double"), F.col("y2") + py)).cast("int")
    rows = rows.withColumns({"cw": right - left, "ch": bottom - top, "cx": left, "cy": top}).where("cw > 0 and ch > 0")
    at = lambda p: F.transform(F.sequence(F.lit(0), F.col("cw") * F.col("ch") - 1), lambda i: F.get(p, (F.floor(i / F.col("cw")).cast("int") + F.col("cy")) * F.col("w") + i % F.col("cw") + F.col("cx")))
    cut = rows.withColumn("planes", F.transform("planes", at))
    return cut.select("image_id", "det_id", F.col("cw").alias("w"), F.col("ch").alias("h"), "planes")


def chroma_420(px: DataFrame) -> DataFrame:
    """U and V of each 2x2 square of RGB pixels, from the whole means of its channels (BT.601, cut)."""
    from ..functions import timecode

    mean = lambda c: F.floor(F.sum(c) / F.count(F.lit(1))).cast("int")
    square = px.groupBy("image_id", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y"))
    rows = square.agg(*(mean(c).alias(c) for c in "rgb"))
    return rows.select("image_id", "x", "y", timecode.rgb_to_yuv(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("image_id", "x", "y", "c.u", "c.v")
