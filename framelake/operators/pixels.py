"""Per-pixel operators on the long form, fused by Catalyst into one projection when chained."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color

NAMES = ("r", "g", "b", "v", "a")


def adjust(px: DataFrame, f: Callable, *args, **kwargs) -> DataFrame:
    """px with a function of functions.color applied to its channel columns."""
    channels = {k: F.col(k) for k in NAMES if k in px.columns}
    if f is color.vignette:
        kwargs |= {k: F.col(k) for k in ("x", "y", "w", "h")}
    new = f(channels, *args, **kwargs)
    return px.select(*(c for c in px.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def filter_chain(px: DataFrame, settings: dict) -> DataFrame:
    """Colour settings by name, applied in the fixed order of the command line; what is not set is left out."""
    order = ("brightness", "contrast", "saturation", "hue", "gamma", "grayscale", "sepia", "invert", "temperature", "tint", "vibrance", "vignette", "chromakey", "posterize", "solarize")
    for name in order:
        value = settings.get(name)
        if value is None or value is False:
            continue
        args = () if value is True else value if isinstance(value, tuple) else (value,)
        px = adjust(px, getattr(color, name), *args)
    unknown = set(settings) - set(order)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return px
