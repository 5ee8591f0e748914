"""What this engine can read, write and do, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .jobs import OPERATIONS

READ = ("png", "jpeg", "bmp", "ppm", "wav", "flac", "ivf", "avi", "mp4", "mkv", "srt", "vtt", "ass", "exif", "ogg")
WRITE = ("png", "jpeg", "bmp", "ppm", "gif", "svg", "wav", "flac", "ivf", "mp4", "ogg", "srt", "vtt", "ass")
#: Formats whose pictures or sounds can't be decoded or encoded; their packets can be cut and joined in the containers above.
WITHOUT_CODEC = ("webp", "av1", "opus", "mp3", "aac", "vorbis")


def report(spark: SparkSession) -> DataFrame:
    rows = [("read", n, True) for n in READ] + [("write", n, True) for n in WRITE] + [("codec", n, False) for n in WITHOUT_CODEC] + [("operation", n, True) for n in OPERATIONS]
    return spark.createDataFrame(rows, "kind string, name string, available boolean")
