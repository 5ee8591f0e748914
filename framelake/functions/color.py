"""Colour adjustments as Column expressions on 8-bit channels.

Each function takes a dict of channel columns (v, or r, g, b, and a where there is one) and gives a new one; alpha stays.
Parameters are checked when the plan is built. Values are clamped to 0..255 and rounded half up, as floor(x + 0.5).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Channels = dict[str, Column]

#: Rec. 709 luma weights, the sepia matrix, RGB to YIQ and back.
REC709 = (0.2126, 0.7152, 0.0722)
SEPIA = {"r": (0.393, 0.769, 0.189), "g": (0.349, 0.686, 0.168), "b": (0.272, 0.534, 0.131)}
YIQ = ((0.299, 0.587, 0.114), (0.596, -0.274, -0.322), (0.211, -0.523, 0.312))
RGB = {"r": (0.956, 0.621), "g": (-0.272, -0.647), "b": (-1.105, 1.702)}
#: The distance of black and white, and the keys of the two screens.
FULL_DISTANCE = 441.67
GREEN_SCREEN, BLUE_SCREEN = (0, 177, 64), (0, 71, 187)


def finite(value: float, name: str) -> float:
    if not math.isfinite(value):
        raise ValueError(f"{name} must be finite")
    return float(value)


def within(value: float, low: float, high: float, name: str) -> float:
    return max(low, min(high, finite(value, name)))


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))


def to_u8(v: Column) -> Column:
    return F.floor(clamp(v) + F.lit(0.5)).cast("int")


def truncated(v: Column) -> Column:
    return F.floor(clamp(v)).cast("int")


def color(c: Channels) -> list[str]:
    return [k for k in c if k != "a"]


def each(c: Channels, f) -> Channels:
    return {k: f(v) if k != "a" else v for k, v in c.items()}


def luma(c: Channels, weights=REC709) -> Column:
    return F.lit(weights[0]) * c["r"] + F.lit(weights[1]) * c["g"] + F.lit(weights[2]) * c["b"]


def grayscale(c: Channels) -> Channels:
    return each(c, lambda v: to_u8(luma(c))) if "r" in c else c


def invert(c: Channels) -> Channels:
    return each(c, lambda v: F.lit(255) - v)


def brightness(c: Channels, amount: float) -> Channels:
    delta = 255.0 * within(amount, -100, 100, "amount") / 100.0
    return each(c, lambda v: to_u8(v + F.lit(delta)))


def contrast(c: Channels, amount: float) -> Channels:
    k = within(amount, -100, 100, "amount") * 255.0 / 100.0
    factor = 259.0 * (k + 255.0) / (255.0 * (259.0 - k))
    return each(c, lambda v: to_u8((v - F.lit(128.0)) * F.lit(factor) + F.lit(128.0)))


def saturation(c: Channels, amount: float) -> Channels:
    factor = 1.0 + within(amount, -100, 100, "amount") / 100.0
    if "r" not in c:
        return c
    return each(c, lambda v: to_u8(luma(c) + (v - luma(c)) * F.lit(factor)))


def hue(c: Channels, degrees: float) -> Channels:
    turn = math.radians(finite(degrees, "degrees"))
    if "r" not in c:
        return c
    unit = {k: c[k] / F.lit(255.0) for k in "rgb"}
    y, i, q = (sum((F.lit(w) * unit[k] for w, k in zip(row[1:], "gb")), F.lit(row[0]) * unit["r"]) for row in YIQ)
    i, q = i * F.lit(math.cos(turn)) - q * F.lit(math.sin(turn)), i * F.lit(math.sin(turn)) + q * F.lit(math.cos(turn))
    return {k: to_u8((y + F.lit(RGB[k][0]) * i + F.lit(RGB[k][1]) * q) * F.lit(255.0)) if k in RGB else v for k, v in c.items()}


def exposure(c: Channels, stops: float) -> Channels:
    gain = 2.0 ** finite(stops, "stops")
    return each(c, lambda v: to_u8(v * F.lit(gain)))


def gamma(c: Channels, value: float) -> Channels:
    if finite(value, "gamma") <= 0:
        raise ValueError("gamma must be positive")
    return each(c, lambda v: to_u8(F.pow(v / F.lit(255.0), F.lit(float(value))) * F.lit(255.0)))


def sepia(c: Channels) -> Channels:
    if "r" not in c:
        c = {**{k: c["v"] for k in "rgb"}, **{k: v for k, v in c.items() if k == "a"}}
    return {k: to_u8(luma(c, SEPIA[k])) if k in SEPIA else v for k, v in c.items()}


def vignette(c: Channels, strength: float, radius: float, x: Column, y: Column, w: Column, h: Column) -> Channels:
    strength, radius = within(strength, 0, 2, "strength"), within(radius, 0.1, 1, "radius")
    cx, cy = w / F.lit(2.0), h / F.lit(2.0)
    most = F.sqrt(cx * cx + cy * cy)
    distance = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    inner = most * F.lit(radius)
    # a radius of 1 leaves nothing to darken
    fade = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(1.0), (distance - inner) / F.nullif(most - inner, F.lit(0.0)) * F.lit(strength)))
    factor = F.when(distance < inner, F.lit(1.0)).otherwise(F.coalesce(fade, F.lit(0.0)))
    return each(c, lambda v: to_u8(v * factor))


def chromakey(c: Channels, key: tuple[int, int, int], tolerance: float, softness: float) -> Channels:
    """Adds or scales alpha by the distance to the key colour; alpha is cut, not rounded."""
    tolerance, softness = within(tolerance, 0, 1, "tolerance"), within(softness, 0, 1, "softness")
    alpha = c.get("a", F.lit(255))
    distance = F.sqrt(sum(((c[k] - F.lit(float(v))) * (c[k] - F.lit(float(v))) for k, v in zip("gb", key[1:])), (c["r"] - F.lit(float(key[0]))) * (c["r"] - F.lit(float(key[0])))))
    near, band = tolerance * FULL_DISTANCE, softness * FULL_DISTANCE * 0.2
    out = F.when(distance < F.lit(near), F.lit(0.0))
    if band > 0:
        out = out.when(distance < F.lit(near + band), alpha * ((distance - F.lit(near)) / F.lit(band)))
    return {**{k: c[k] for k in "rgb"}, "a": truncated(out.otherwise(alpha.cast("double")))}


def remove_green_screen(c: Channels, tolerance: float, softness: float) -> Channels:
    return chromakey(c, GREEN_SCREEN, tolerance, softness)


def remove_blue_screen(c: Channels, tolerance: float, softness: float) -> Channels:
    return chromakey(c, BLUE_SCREEN, tolerance, softness)


def posterize(c: Channels, levels: int) -> Channels:
    step = 255.0 / (max(2, int(levels)) - 1)
    return each(c, lambda v: truncated(F.floor(v / F.lit(step) + F.lit(0.5)) * F.lit(step)))


def solarize(c: Channels, threshold: int) -> Channels:
    return each(c, lambda v: F.when(v > threshold, F.lit(255) - v).otherwise(v))


def temperature(c: Channels, amount: float) -> Channels:
    half = within(amount, -100, 100, "temperature") / 2.0
    return {k: to_u8(v + F.lit(half)) if k == "r" else to_u8(v - F.lit(half)) if k == "b" else v for k, v in c.items()}


def tint(c: Channels, amount: float) -> Channels:
    half = within(amount, -100, 100, "tint") / 2.0
    return {k: to_u8(v - F.lit(half)) if k == "g" else v for k, v in c.items()}


def vibrance(c: Channels, amount: float) -> Channels:
    """Raises saturation more where there is little: by amount/100 times what is left of it."""
    amount = within(amount, -100, 100, "vibrance") / 100.0
    top, low = F.greatest(*(c[k] for k in "rgb")), F.least(*(c[k] for k in "rgb"))
    share = F.when(top > 0, (top - low) / top).otherwise(F.lit(0.0))
    factor = F.lit(1.0) + F.lit(amount) * (F.lit(1.0) - share)
    return each(c, lambda v: to_u8(luma(c) + (v - luma(c)) * factor))
