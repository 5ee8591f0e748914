"""Structured Streaming: image folders, windowed levels of signals with late data, and silence runs as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import timecode


def image_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """New files of a folder: path, length and the format that their first bytes show."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", timecode.sniff(F.col("content")).alias("format"))


def level_stream(samples: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Peak, root mean square and count of (clip_id, ts, s) in event-time windows; later samples than late go."""
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", window), "clip_id")
    out = w.agg(F.max(F.abs("s")).alias("peak"), F.sqrt(F.avg(F.col("s") * F.col("s"))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "clip_id", "peak", "rms", "n")


def silence_stream(samples: DataFrame, threshold: float, least: int) -> DataFrame:
    """Runs of at least so many quiet samples of (clip_id, i, s), given out when a loud sample ends them.

    Samples of a clip come in order over batches; the state of a clip is the start and length of its open run.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (-1, 0)
        found = []
        for batch in batches:
            for i, s in batch.sort_values("i")[["i", "s"]].itertuples(index=False):
                if abs(s) <= threshold:
                    start, n = (int(i), 1) if n == 0 else (start, n + 1)
                else:
                    if n >= least:
                        found.append((key[0], start, start + n))
                    start, n = -1, 0
        state.update((start, n))
        yield pd.DataFrame(found, columns=["clip_id", "start", "end"])

    return samples.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, start long, end long", "start long, n long", "append", GroupStateTimeout.NoTimeout)
