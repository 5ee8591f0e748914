"""Drawing on images: text, subtitles with glyphs, detections, poses, recognised text, analysed faces; plots of audio.

Images are rows of planes; what is drawn is gathered to one row an image first, as an image has few of each. Null text and images
without anything to draw stay as they are; a row without planes has its error in the column error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import image as pictures
from ..kernels import text as glyphs
from ..plans.models import PICTURE, array, cells, rows


def draw_text(df: DataFrame, text: str | None = None, text_col: str = "text", **settings) -> DataFrame:
    """One text for all images, or each image's own of a column; settings are those of kernels.text.draw_text."""
    glyphs.draw_text(pictures.np.zeros((1, 1, 3), "uint8"), "", **settings)  # bad settings fail here

    def one(row: dict) -> dict:
        value = text if text is not None else row[text_col]
        return cells(glyphs.draw_text(array(row), value, **settings) if value else array(row))

    return rows(df, one, PICTURE)


def draw_texts(df: DataFrame, texts: DataFrame, **settings) -> DataFrame:
    """Texts (image_id, text, x, y) of images, in order of y and x."""
    grouped = texts.where("text is not null").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "text"))).alias("texts"))

    def one(row: dict) -> dict:
        image = array(row)
        for t in row["texts"] or ():
            image = glyphs.draw_text(image, t["text"], t["x"], t["y"], **settings)
        return cells(image)

    return rows(df.join(grouped, "image_id", "left"), one, PICTURE)


def subtitles(frames: DataFrame, cues: DataFrame, size: int = 16, anchor: str = "bottom-center", margin: int = 8, width: float = 10.0, **settings) -> DataFrame:
    """Frames (image_id, t, w, h, planes) with the text of all active cues (start, end, text); cues meet frames by time slots."""
    slots = cues.select("start", "end", "text", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("slot"))
    points = frames.select("image_id", "t", F.floor(F.col("t") / width).alias("slot"))
    active = points.join(slots, "slot").where("start <= t and t < end").groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda c: c["text"]), "\n").alias("text"))
    settings = {"outline": (0, 0, 0)} | settings
    return draw_text(frames.drop("text").join(active, "image_id", "left"), size=size, anchor=anchor, margin=margin, **settings)


def detections(df: DataFrame, boxes: DataFrame, color=(0, 255, 0), mark=(255, 0, 0)) -> DataFrame:
    """Boxes (image_id, x, y, w, h, and perhaps landmarks) of images."""
    marks = F.col("landmarks") if "landmarks" in boxes.columns else F.array().cast("array<array<double>>")
    grouped = boxes.where("x is not null").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col("w").alias("bw"), F.col("h").alias("bh"), marks.alias("landmarks")))).alias("boxes"))

    def one(row: dict) -> dict:
        found = row["boxes"] or []
        spots = [tuple(point) for b in found for point in b["landmarks"] or ()]
        return cells(pictures.draw_boxes(array(row), [(b["x"], b["y"], b["x"] + b["bw"], b["y"] + b["bh"]) for b in found], spots, color, mark))

    return rows(df.join(grouped, "image_id", "left"), one, PICTURE)


def poses(df: DataFrame, people: DataFrame, least: float = 0.3) -> DataFrame:
    """Skeletons of people (image_id, person, points of x, y, confidence) on images."""
    grouped = people.where("points is not null").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("person", "points"))).alias("people"))

    def one(row: dict) -> dict:
        image = array(row)
        for person in row["people"] or ():
            image = pictures.draw_pose(image, person["points"], least)
        return cells(image)

    return rows(df.join(grouped, "image_id", "left"), one, PICTURE)


def recognised(df: DataFrame, found: DataFrame, color=(0, 255, 0)) -> DataFrame:
    """The outlines of blocks of text (as extract_text gives them) on images."""
    blocks = found.select("image_id", "blocks")

    def one(row: dict) -> dict:
        image = array(row).copy()
        for block in row["blocks"] or ():
            corners = [(int(x), int(y)) for x, y in block["vertices"]]
            for a, b in zip(corners, corners[1:] + corners[:1]):
                pictures.line(image, a, b, color)
        return cells(image)

    return rows(df.join(blocks, "image_id", "left"), one, PICTURE)


def analysis(df: DataFrame, faces: DataFrame, color=(0, 255, 0)) -> DataFrame:
    """Boxes of analysed faces with age, gender and emotion above them."""
    fields = ("det_id", "x", "y", F.col("w").alias("bw"), F.col("h").alias("bh"), "age", "gender", "emotion")
    grouped = faces.where("x is not null").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("faces"))

    def one(row: dict) -> dict:
        image = array(row)
        for f in row["faces"] or ():
            image = pictures.draw_boxes(image, [(f["x"], f["y"], f["x"] + f["bw"], f["y"] + f["bh"])], (), color)
            low = int(max(0.0, f["age"] or 0.0) // 5 * 5)
            image = glyphs.draw_text(image, f"{low}-{low + 5} {f['gender']} {f['emotion']}", f["x"], f["y"] - glyphs.TALL, color=color)
        return cells(image)

    return rows(df.join(grouped, "image_id", "left"), one, PICTURE)


def waveforms(points: DataFrame, height: int = 64, color=(0, 160, 255)) -> DataFrame:
    """Images of the points (clip_id, bucket, low, high) of operators.audio.waveform_points; image_id is the clip."""
    grouped = points.groupBy(F.col("clip_id").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("bucket", "low", "high"))).alias("points"))
    return rows(grouped, lambda row: cells(pictures.render_waveform([(q["low"], q["high"]) for q in row["points"]], height, color)), PICTURE)


def spectra(levels: DataFrame, height: int = 64, width: int = 128) -> DataFrame:
    """Images of bars of the magnitudes (clip_id, k, magnitude) of operators.audio.spectra."""
    grouped = levels.groupBy(F.col("clip_id").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("k", "magnitude"))).alias("levels"))
    return rows(grouped, lambda row: cells(pictures.render_bars(pictures.np.array([q["magnitude"] for q in row["levels"]]), height, width)), PICTURE)


def spectrograms(levels: DataFrame, width: int, height: int) -> DataFrame:
    """Luma images of the levels (clip_id, x, y, level 0..1) of operators.audio.spectrograms, the lowest band below."""
    grouped = levels.groupBy(F.col("clip_id").alias("image_id")).agg(F.collect_list(F.struct("x", "y", "level")).alias("levels"))

    def one(row: dict) -> dict:
        out = pictures.np.zeros((height, width, 1), "uint8")
        for q in row["levels"]:
            out[height - 1 - q["y"], q["x"], 0] = int(q["level"] * 255 + 0.5)
        return cells(out)

    return rows(grouped, one, PICTURE)


def vectorized(df: DataFrame, levels: int = 4, speckle: int = 4) -> DataFrame:
    """image_id and an SVG of each image."""
    if levels < 2 or speckle < 0:
        raise ValueError("levels must be 2 or more and speckle not negative")
    return rows(df, lambda row: {"svg": pictures.vectorize(array(row), levels, speckle)}, "image_id long, svg string, error string")
