"""Audio as Column expressions on arrays of samples in -1..1: maps and aggregate-then-map, without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

CURVES = ("linear", "logarithmic", "exponential", "s_curve", "sine")
DISTORTIONS = ("overdrive", "hard_clip", "tube", "fuzz", "bitcrush")


def db_to_linear(db: float) -> float:
    return 10.0 ** (db / 20.0)


def linear_to_db(v: Column) -> Column:
    """20 log10; minus infinity at 0 and below."""
    return F.when(v <= 0, F.lit(float("-inf"))).otherwise(20.0 * F.log10(F.greatest(v, F.lit(1e-300))))


def floored_db(v: Column) -> Column:
    """The form of the effects: the magnitude, not below -200 dB."""
    return 20.0 * F.log10(F.greatest(F.abs(v), F.lit(1e-10)))


def unit(v: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))


def peak(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(s, F.abs)), F.lit(0.0))


def mean_square(s: Column) -> Column:
    return F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda t, v: t + v * v) / F.size(s)).otherwise(0.0)


def rms(s: Column) -> Column:
    return F.sqrt(mean_square(s))


def gain(s: Column, factor: float) -> Column:
    return F.transform(s, lambda v: unit(v * F.lit(float(factor))))


def volume(s: Column, db: float) -> Column:
    return gain(s, db_to_linear(db))


def limit(s: Column, db: float) -> Column:
    top = db_to_linear(db)
    return F.transform(s, lambda v: F.greatest(F.lit(-top), F.least(F.lit(top), v)))


def invert_phase(s: Column) -> Column:
    return F.transform(s, lambda v: -v)


def remove_dc(s: Column) -> Column:
    mean = F.aggregate(s, F.lit(0.0), lambda t, v: t + v) / F.nullif(F.size(s), F.lit(0))
    return let(mean, lambda m: F.transform(s, lambda v: v - m))


def normalize_peak(s: Column, db: float) -> Column:
    return let(peak(s), lambda top: F.when(top < 1e-10, s).otherwise(F.transform(s, lambda v: unit(v * (F.lit(db_to_linear(db)) / top)))))


def normalize_rms(s: Column, db: float) -> Column:
    """To a root mean square, but no further than a peak of 1."""
    factor = F.least(F.lit(db_to_linear(db)) / rms(s), F.lit(1.0) / peak(s))
    return F.when(rms(s) < 1e-10, s).otherwise(let(factor, lambda k: F.transform(s, lambda v: unit(v * k))))


def curve(p: Column, kind: str) -> Column:
    """A fade's gain at progress p; the logarithmic curve is p (1 - p) from 0.001 on."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    if kind not in CURVES:
        raise ValueError(f"unknown curve {kind}")
    return {"linear": p, "logarithmic": F.when(p < 0.001, F.lit(0.0)).otherwise(p * (F.lit(1.0) - p)), "exponential": p * p, "s_curve": p * p * (F.lit(3.0) - F.lit(2.0) * p), "sine": F.sin(p * F.lit(math.pi / 2))}[kind]


def fade_in(s: Column, rate: int, seconds: float, kind: str = "linear") -> Column:
    n = F.least(F.lit(int(rate * seconds)), F.size(s))
    return F.transform(s, lambda v, i: F.when(i < n, v * curve(i / n, kind)).otherwise(v))


def fade_out(s: Column, rate: int, seconds: float, kind: str = "linear") -> Column:
    n = F.least(F.lit(int(rate * seconds)), F.size(s))
    first = F.size(s) - n
    return F.transform(s, lambda v, i: F.when(i >= first, v * curve(F.lit(1.0) - (i - first) / n, kind)).otherwise(v))


def fade_in_out(s: Column, rate: int, seconds_in: float, seconds_out: float, kind: str = "linear") -> Column:
    return fade_out(fade_in(s, rate, seconds_in, kind), rate, seconds_out, kind)


def distortion(s: Column, kind: str, drive: float, level: float = 1.0) -> Column:
    if kind not in DISTORTIONS:
        raise ValueError(f"unknown distortion {kind}")
    steps = 2.0 ** max(2.0, min(16.0, 16.0 - drive * 0.14))

    def f(v: Column) -> Column:
        d = v * F.lit(float(drive))
        sign = F.signum(d)
        return {
            "overdrive": F.tanh(d),
            "hard_clip": unit(d),
            "tube": sign * (F.lit(1.0) - F.exp(-F.abs(d))),
            "fuzz": sign * (F.lit(1.0) - F.exp(F.abs(d) * F.lit(-3.0))),
            "bitcrush": sign * F.floor(F.abs(d) * F.lit(steps) + F.lit(0.5)) / F.lit(steps),
        }[kind] * F.lit(float(level))

    return F.transform(s, f)


def mix(a: Column, b: Column, ratio: float) -> Column:
    """a (1 - ratio) + b ratio; the shorter is padded with silence."""
    return F.zip_with(a, b, lambda x, y: unit(F.coalesce(x, F.lit(0.0)) * F.lit(1.0 - ratio) + F.coalesce(y, F.lit(0.0)) * F.lit(float(ratio))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: unit(F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))


def mono_to_stereo(s: Column) -> Column:
    return F.flatten(F.transform(s, lambda v: F.array(v, v)))


def stereo_to_mono(s: Column) -> Column:
    """The mean of each pair; a last single sample stays."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 2).cast("int")), lambda k: (F.get(s, 2 * k) + F.coalesce(F.get(s, 2 * k + 1), F.get(s, 2 * k))) / 2.0)


def channel(s: Column, k: int, channels: int) -> Column:
    return F.filter(s, lambda v, i: i % channels == k) if k < channels else F.filter(s, lambda v: F.lit(False))


def to_mono(s: Column, channels: int) -> Column:
    """The mean over the channels of each whole frame."""
    frames = F.floor(F.size(s) / channels).cast("int")
    one = lambda k: sum((F.get(s, k * channels + c) for c in range(1, channels)), F.get(s, k * channels)) / float(channels)
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), one)).otherwise(F.slice(s, 1, 0))


def interleave(left: Column, right: Column) -> Column:
    n = F.least(F.size(left), F.size(right))
    return F.flatten(F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: F.array(a, b)))


def trim_silence(s: Column, db: float, keep: int) -> Column:
    """From the first to the last loud sample, with up to keep samples around; an all silent clip stays whole."""
    top = db_to_linear(db)
    loud = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.abs(F.get(s, i)) > top)
    first = F.greatest(F.coalesce(F.array_min(loud) - keep, F.lit(0)), F.lit(0))
    last = F.least(F.coalesce(F.array_max(loud) + 1 + keep, F.size(s)), F.size(s))
    return F.when(F.size(s) == 0, s).otherwise(F.slice(s, first + 1, last - first))


def resample(s: Column, ratio: float, length: Column) -> Column:
    """Linear interpolation at i * ratio for i below length; behind the end the last sample."""

    def at(i: Column) -> Column:
        p = i * F.lit(float(ratio))
        k = F.floor(p).cast("int")
        f = p - k
        a = F.get(s, k)
        return F.coalesce(a * (F.lit(1.0) - f) + F.get(s, k + 1) * f, a, F.lit(0.0))

    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), at)).otherwise(F.slice(s, 1, 0))


def pitch_shift(s: Column, semitones: float) -> Column:
    """By resampling, so the length changes too."""
    ratio = 2.0 ** (max(-24.0, min(24.0, semitones)) / 12.0)
    return resample(s, ratio, F.floor(F.size(s) / F.lit(ratio) + F.lit(1e-9)).cast("int"))


def resample_linear(s: Column, source: int, target: int) -> Column:
    """To another rate; at least one sample."""
    n = F.greatest(F.lit(1), F.floor(F.size(s) * target / source + F.lit(0.5)).cast("int"))
    return s if source == target else resample(s, source / target, n)


def pcm(s: Column, bits: int) -> Column:
    """Integer samples for a WAV file, cut towards zero."""
    top = {8: 127, 16: 32767, 24: 8388607, 32: 2147483647}[bits]
    cut = lambda v: (F.signum(v) * F.floor(F.abs(v))).cast("long")
    return F.transform(s, lambda v: F.greatest(F.lit(-top - 1), F.least(F.lit(top), cut(v * F.lit(float(top))))))
