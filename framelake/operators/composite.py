"""Compositing: positional joins of images, and regions drawn by geometric predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let


def rgba(df: DataFrame) -> DataFrame:
    """Planes as R, G, B, A, whatever they were."""
    p, n = F.col("planes"), F.size("planes")
    full = F.transform(p[0], lambda _: F.lit(255))
    out = F.when(n == 1, F.array(p[0], p[0], p[0], full)).when(n == 2, F.array(p[0], p[0], p[0], F.get(p, F.lit(1)))).when(n == 3, F.array(p[0], F.get(p, F.lit(1)), F.get(p, F.lit(2)), full)).otherwise(p)
    return df.withColumn("planes", out)


def over(base: Column, layer: Column, opacity: float) -> list[Column]:
    """Source-over of two pixels (structs r, g, b, a), as four values."""
    sa = layer["a"] / F.lit(255.0) * F.lit(opacity)
    da = base["a"] / F.lit(255.0)
    oa = sa + da * (F.lit(1.0) - sa)
    up = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)) + F.lit(0.5 + 1e-9)).cast("int")
    mixed = [up((layer[c] * sa + base[c] * da * (F.lit(1.0) - sa)) / F.greatest(oa, F.lit(1e-6))) for c in "rgb"]
    return [*mixed, up(oa * F.lit(255.0))]


def watermark(base: DataFrame, layer: DataFrame, x: int, y: int, opacity: float = 1.0) -> DataFrame:
    """The layer of the same image_id over the base from (x, y) on; one that does not fit fails the job.

    The layers may be one for all images: an image_id of null goes with each base, and is broadcast as a single row.
    """
    opacity = max(0.0, min(1.0, opacity))
    layer = rgba(layer).select(F.col("image_id").alias("l_id"), F.col("w").alias("lw"), F.col("h").alias("lh"), F.col("planes").alias("l"))
    rows = rgba(base).join(layer, F.col("image_id") == F.col("l_id"))
    bad = (F.lit(x) + F.col("lw") > F.col("w")) | (F.lit(y) + F.col("lh") > F.col("h"))
    w = F.col("w")
    zipped = F.arrays_zip(*(F.col("planes")[k].alias(c) for k, c in enumerate("rgba")))

    def at(b: Column, i: Column) -> Column:
        lx, ly = i % w - x, F.floor(i / w).cast("int") - y
        j = ly * F.col("lw") + lx
        ok = (lx >= 0) & (lx < F.col("lw")) & (ly >= 0) & (ly < F.col("lh"))
        top = F.struct(*(F.get(F.col("l")[k], j).alias(c) for k, c in enumerate("rgba")))
        return F.when(ok, F.array(*over(b, top, opacity))).otherwise(F.array(b["r"], b["g"], b["b"], b["a"]))

    checked = F.when(bad, F.raise_error(F.lit("overlay is out of bounds"))).otherwise(F.lit(1))
    rows = rows.where(checked.cast("int") == 1).withColumn("mixed", F.transform(zipped, at))
    planes = F.array(*map(_channel, range(4)))
    return rows.select("image_id", "w", "h", planes.alias("planes"))


def _channel(k: int) -> Column:
    return F.transform("mixed", lambda m: m[k])


def overlay(base: DataFrame, layer: DataFrame, x: int, y: int) -> DataFrame:
    return watermark(base, layer, x, y, 1.0)


def create_mask(df: DataFrame, rectangles: list[tuple[int, int, int, int]], circles: list[tuple[int, int, int]]) -> DataFrame:
    """A plane with 255 in any of the rectangles (x, y, w, h) or circles (cx, cy, r) for each image's size."""
    w = F.col("w")

    def at(i: Column) -> Column:
        x, y = i % w, F.floor(i / w).cast("int")
        hit = F.lit(False)
        for rx, ry, rw, rh in rectangles:
            hit = hit | ((x >= rx) & (x < rx + rw) & (y >= ry) & (y < ry + rh))
        for cx, cy, r in circles:
            hit = hit | ((x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r)
        return F.when(hit, 255).otherwise(0)

    return df.select("image_id", "w", "h", F.array(F.transform(F.sequence(F.lit(0), w * F.col("h") - 1), at)).alias("planes"))


def depth_blur(df: DataFrame, depth: Column, focus: float, strength: float) -> DataFrame:
    """Each pixel's mean over a square whose radius, 10 at most, grows with its depth's distance from the focus.

    depth is an array column of 0..1 for each pixel of the row.
    """
    w, h = F.col("w"), F.col("h")

    def plane(p: Column, depths: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            x, y = i % w, F.floor(i / w).cast("int")
            r = F.least(F.lit(10), F.floor(F.abs(F.get(depths, i) - F.lit(float(focus))) * F.lit(float(strength)) + F.lit(1e-9)).cast("int"))
            xs = F.sequence(F.greatest(F.lit(0), x - r), F.least(w - 1, x + r))
            ys = F.sequence(F.greatest(F.lit(0), y - r), F.least(h - 1, y + r))
            whole = F.aggregate(ys, F.lit(0), lambda s, j: s + F.aggregate(F.slice(p, j * w + F.greatest(F.lit(0), x - r) + 1, F.size(xs)), F.lit(0), lambda t, u: t + u))
            return F.floor(whole / (F.size(xs) * F.size(ys))).cast("int")

        return F.transform(p, at)

    return df.withColumn("planes", let(depth, lambda depths: F.transform("planes", lambda p: plane(p, depths))))


def subtitle_box(frames: DataFrame, cues: DataFrame, top: float = 0.9, char_width: float = 0.55, font: float = 0.05, width: float = 10.0) -> DataFrame:
    """Frames (image_id, t, w, h, planes), one row for each active cue (start, end, text), with a filled box; boxes, not glyphs.

    Cues are dealt to the time slots of width seconds they touch, so frames meet them by an equi-join; a frame without a
    cue stays as it is.
    """
    slots = cues.select("start", "end", "text", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("s2"))
    rows = frames.withColumn("slot", F.floor(F.col("t") / width))
    rows = rows.join(slots, (F.col("slot") == F.col("s2")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")), "left")
    w, h = F.col("w"), F.col("h")
    size = h * F.lit(font)

    def paint(box: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            x, y = i % w, F.floor(i / w).cast("int")
            hit = (F.abs(x - w / F.lit(2.0)) <= box["half"]) & (F.abs(y - h * F.lit(top)) <= box["tall"])
            return F.when(hit, 255).otherwise(v)

        return F.transform("planes", lambda p: F.transform(p, at))

    box = F.struct((F.length("text") * size * F.lit(char_width) / F.lit(2.0)).alias("half"), (size / F.lit(2.0)).alias("tall"))
    painted = F.when(F.col("text").isNotNull(), let(box, paint)).otherwise(F.col("planes"))
    return rows.withColumn("planes", painted).drop("slot", "s2")
