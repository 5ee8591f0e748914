"""Timecodes, sizes, colours and other small text formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frame rates with their exact fractions, and bitrates (kbit/s) of H.264 by pixels.
RATES = ((23.976, 24000, 1001), (24.0, 24, 1), (25.0, 25, 1), (29.97, 30000, 1001), (30.0, 30, 1), (50.0, 50, 1), (59.94, 60000, 1001), (60.0, 60, 1))
BITRATES = ((307200, 1000), (921600, 2500), (2073600, 5000), (3686400, 10000))
CONTAINERS = {"mp4": "mp4", "m4v": "mp4", "mov": "mp4", "mkv": "mkv", "webm": "webm", "ivf": "ivf", "avi": "avi"}
#: The first bytes of image formats.
MAGIC = (("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("00000100", "ico"), ("52494646", "webp"))


def _clock(seconds: Column, units: int) -> tuple[Column, Column, Column, Column]:
    """Hours, minutes, seconds and the rest in 1/units s, cut"""
    total = F.floor(F.greatest(F.lit(0.0), seconds) * units).cast("bigint")
    whole = F.floor(total / units).cast("bigint")
    return F.floor(whole / 3600).cast("bigint"), F.floor(whole / 60).cast("bigint") % 60, whole % 60, total % units


def srt_time(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_clock(seconds, 1000))


def vtt_time(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d.%03d", *_clock(seconds, 1000))


def ass_time(seconds: Column) -> Column:
    return F.format_string("%d:%02d:%02d.%02d", *_clock(seconds, 100))


def parse_time(text: Column) -> Column:
    """H:MM:SS with , or . before the fraction; null for anything else."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 3, number(0) * 3600.0 + number(1) * 60.0 + number(2))


def strip_tags(text: Column) -> Column:
    """Without <...>; a single > goes, a single < takes the rest."""
    return F.replace(F.regexp_replace(text, r"(?s)<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))


def strip_ass_tags(text: Column) -> Column:
    r"""Without {...}, with \N and \n as line ends."""
    return F.regexp_replace(F.replace(F.regexp_replace(text, r"(?s)\{[^}]*(\}|$)", ""), F.lit("}"), F.lit("")), r"\\[Nn]", "\n")


def hex_color(text: Column) -> Column:
    """r, g, b, a of RRGGBB or RRGGBBAA, with or without #; null for anything else."""
    h = F.regexp_replace(text, "^#+", "")
    ok = F.regexp_like(h, F.lit("^([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"))
    part = lambda k: F.conv(F.substring(F.when(ok, F.rpad(h, 8, "F")), k, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), part(7).alias("a"))


def format_size(n: Column) -> Column:
    """Bytes, as any whole number type, in GB, MB or KB of 1024, with two places; the binary value is rounded, half to even."""
    out = None
    for k, name in ((3, "GB"), (2, "MB"), (1, "KB")):
        # format_string and bround round the shortest decimal form of a double, which is up to half a step off its value.
        test, value = n >= 1024**k, F.concat(F.call_function("format_number", n.cast("double") / float(1024**k), F.lit("0.00")), F.lit(f" {name}"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes")))


def format_duration(ms: Column) -> Column:
    """h:mm:ss from an hour, m:ss from a minute, else s.mmms."""
    s = F.floor(ms / 1000).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m % 60, s % 60)).when(m > 0, F.format_string("%d:%02d", m, s % 60)).otherwise(F.format_string("%d.%03ds", s, ms % 1000))


def container_type(path: Column) -> Column:
    names = F.create_map(*(F.lit(v) for pair in CONTAINERS.items() for v in pair))
    return names[F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))]


def sniff(content: Column) -> Column:
    """The image format of a file's first bytes, or null."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for magic, name in MAGIC:
        out = F.when(F.startswith(head, F.lit(magic)), name) if out is None else out.when(F.startswith(head, F.lit(magic)), name)
    return out


def frame_rate(fps: Column) -> Column:
    """(num, den) of the nearest usual rate within 0.01, else the rounded rate over 1."""
    pair = lambda a, b: F.struct(F.lit(a).cast("long").alias("num"), F.lit(b).cast("long").alias("den"))
    out = None
    for value, num, den in RATES:
        test = F.abs(fps - F.lit(value)) < 0.01
        out = F.when(test, pair(num, den)) if out is None else out.when(test, pair(num, den))
    return out.otherwise(F.struct(F.floor(fps + 0.5).cast("long").alias("num"), F.lit(1).cast("long").alias("den")))


def auto_bitrate(w: Column, h: Column, fps: Column) -> Column:
    out = None
    for most, kbps in BITRATES:
        out = F.when(w * h <= most, float(kbps)) if out is None else out.when(w * h <= most, float(kbps))
    return F.floor(out.otherwise(20000.0) * F.sqrt(fps / 30.0)).cast("long")


def time_to_pts(seconds: Column, num: int, den: int) -> Column:
    return F.floor(seconds * float(den) / float(num)).cast("bigint")


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    """BT.709 full range, cut."""
    cut = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)) + F.lit(1e-9)).cast("int")
    return F.struct(cut(y + 1.5748 * (v - 128)).alias("r"), cut(y - 0.1873 * (u - 128) - 0.4681 * (v - 128)).alias("g"), cut(y + 1.8556 * (u - 128)).alias("b"))


def rgb_to_yuv(r: Column, g: Column, b: Column) -> Column:
    """BT.601, cut."""
    cut = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)) + F.lit(1e-9)).cast("int")
    return F.struct(cut(0.299 * r + 0.587 * g + 0.114 * b).alias("y"), cut(128 - 0.169 * r - 0.331 * g + 0.5 * b).alias("u"), cut(128 + 0.5 * r - 0.419 * g - 0.081 * b).alias("v"))
