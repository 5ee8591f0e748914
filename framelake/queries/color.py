"""Colour adjustments over RGB pixels."""

from __future__ import annotations

import math

from .. import model
from ..functions import color
from ..operators import pixels
from . import query

CLAMP = "CAST(floor(greatest(0, least(255, {0})) + 0.5) AS INTEGER)"
CUT = "CAST(floor(greatest(0, least(255, {0}))) AS INTEGER)"
LUMA = "(0.2126::DOUBLE*r + 0.7152::DOUBLE*g + 0.0722::DOUBLE*b)"


def channels(formula: str, clamp: str = CLAMP) -> str:
    return ", ".join(f"{clamp.format(formula.format(v=k))} AS {k}" for k in "rgb")


def add(name: str, select: str, f, *args, alpha: bool = False, source: str = "{rgb8}"):
    columns = ["image_id", "x", "y", "r", "g", "b"] + ["a"] * alpha

    @query(name, f"SELECT image_id, x, y, {select} FROM {source}")
    def run(spark, sf_dir):
        return pixels.adjust(model.pixels(model.rgb8(spark, sf_dir), "r", "g", "b"), f, *args).select(*columns)


C, S = math.cos(math.radians(75)), math.sin(math.radians(75))
UNIT = "(SELECT image_id, x, y, r, g, b, (0.299::DOUBLE*r+0.587*g+0.114*b)/255 AS yy, (0.596::DOUBLE*r-0.274*g-0.322*b)/255 AS ii, (0.211::DOUBLE*r-0.523*g+0.312*b)/255 AS qq FROM {rgb8})"


def hue_sql(a: float, b: float) -> str:
    return CLAMP.format(f"round((yy + {a}::DOUBLE*(ii*{C!r}::DOUBLE - qq*{S!r}::DOUBLE) + {b}::DOUBLE*(ii*{S!r}::DOUBLE + qq*{C!r}::DOUBLE))*255, 9)")


def screen_sql(key: tuple[int, int, int], tolerance: float, softness: float) -> str:
    d = f"sqrt((r-{key[0]})*(r-{key[0]})+(g-{key[1]})*(g-{key[1]})+(b-{key[2]})*(b-{key[2]}))"
    near, band = tolerance * 441.67, softness * 441.67 * 0.2
    return f"r, g, b, CAST(floor(CASE WHEN {d} < {near!r}::DOUBLE THEN 0 WHEN {d} < {near + band!r}::DOUBLE THEN 255*(({d}-{near!r}::DOUBLE)/{band!r}::DOUBLE) ELSE 255 END) AS INTEGER) AS a"


add("px_grayscale", ", ".join(f"{CLAMP.format(LUMA)} AS {k}" for k in "rgb"), color.grayscale)
add("px_invert", "255 - r AS r, 255 - g AS g, 255 - b AS b", color.invert)
add("px_brightness", channels("{v} + 51.0::DOUBLE"), color.brightness, 20)
add("px_contrast", channels("({v} - 128) * (259.0::DOUBLE*306/(255*208.0::DOUBLE)) + 128"), color.contrast, 20)
add("px_saturation", channels(LUMA + " + ({v} - " + LUMA + ") * 1.4::DOUBLE"), color.saturation, 40)
add("px_exposure", channels("{v} * pow(2.0::DOUBLE, 0.7::DOUBLE)"), color.exposure, 0.7)
add("px_gamma", channels("pow({v} / 255.0::DOUBLE, 0.45::DOUBLE) * 255"), color.gamma, 0.45)
add("px_sepia", ", ".join(f"{CLAMP.format(f'{m[0]}::DOUBLE*r + {m[1]}::DOUBLE*g + {m[2]}::DOUBLE*b')} AS {k}" for k, m in {"r": (0.393, 0.769, 0.189), "g": (0.349, 0.686, 0.168), "b": (0.272, 0.534, 0.131)}.items()), color.sepia)
add("px_posterize", channels("floor({v} / 85.0::DOUBLE + 0.5) * 85", CUT), color.posterize, 4)
add("px_solarize", ", ".join(f"CASE WHEN {k} > 128 THEN 255 - {k} ELSE {k} END AS {k}" for k in "rgb"), color.solarize, 128)
add("px_temperature", f"{CLAMP.format('r + 15.0::DOUBLE')} AS r, g, {CLAMP.format('b - 15.0::DOUBLE')} AS b", color.temperature, 30)
add("px_tint", f"r, {CLAMP.format('g - 12.5::DOUBLE')} AS g, b", color.tint, 25)
add("px_vibrance", channels(LUMA + " + ({v} - " + LUMA + ") * (1 + 0.5::DOUBLE*(1 - CASE WHEN greatest(r,g,b) > 0 THEN (greatest(r,g,b) - least(r,g,b)) / greatest(r,g,b)::DOUBLE ELSE 0 END))"), color.vibrance, 50)
D = "sqrt((x-4)*(x-4)+(y-4)*(y-4))"
R = f"{math.sqrt(32.0)!r}::DOUBLE"
add("px_vignette", channels("{v} * CASE WHEN " + D + f" < {R}*0.5 THEN 1 ELSE greatest(0, 1 - least(1, ({D} - {R}*0.5) / ({R} - {R}*0.5) * 0.8::DOUBLE)) END"), color.vignette, 0.8, 0.5)
add("px_chromakey", screen_sql((128, 128, 128), 0.1, 0.5), color.chromakey, (128, 128, 128), 0.1, 0.5, alpha=True)
add("px_green_screen", screen_sql((0, 177, 64), 0.3, 1.0), color.remove_green_screen, 0.3, 1.0, alpha=True)
add("px_blue_screen", screen_sql((0, 71, 187), 0.3, 1.0), color.remove_blue_screen, 0.3, 1.0, alpha=True)


@query("px_hue", f"SELECT image_id, x, y, {hue_sql(0.956, 0.621)} AS r, {hue_sql(-0.272, -0.647)} AS g, {hue_sql(-1.105, 1.702)} AS b FROM {UNIT}")
def px_hue(spark, sf_dir):
    return pixels.adjust(model.pixels(model.rgb8(spark, sf_dir), "r", "g", "b"), color.hue, 75).select("image_id", "x", "y", "r", "g", "b")


STEP = "(SELECT image_id, x, y, {0} FROM {1})"
CHAIN = STEP.format(channels("{v} + 25.5::DOUBLE"), "{rgb8}")
CHAIN = STEP.format(channels(LUMA + " + ({v} - " + LUMA + ") * 0.7::DOUBLE"), CHAIN)
CHAIN = STEP.format("255 - r AS r, 255 - g AS g, 255 - b AS b", CHAIN)
CHAIN = STEP.format(f"{CLAMP.format('r + 10.0::DOUBLE')} AS r, g, {CLAMP.format('b - 10.0::DOUBLE')} AS b", CHAIN)


@query("px_filter_chain", f"SELECT image_id, x, y, {', '.join(f'CASE WHEN {k} > 200 THEN 255 - {k} ELSE {k} END AS {k}' for k in 'rgb')} FROM {CHAIN}")
def px_filter_chain(spark, sf_dir):
    px = model.pixels(model.rgb8(spark, sf_dir), "r", "g", "b")
    settings = {"solarize": 200, "brightness": 10, "saturation": -30, "invert": True, "temperature": 20}
    return pixels.filter_chain(px, settings).select("image_id", "x", "y", "r", "g", "b")
