"""Video editing as operations on packet and frame rows; nothing is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 90_000


def trim(packets: DataFrame, start: float, end: float) -> DataFrame:
    """From the first keyframe at or after start until end, in seconds."""
    a, b = int(start * SCALE), int(end * SCALE)
    first = F.min(F.when(F.col("is_keyframe") & (F.col("pts") >= a), F.col("pts"))).over(W.partitionBy("source"))
    return packets.withColumn("first", first).where((F.col("pts") >= F.col("first")) & (F.col("pts") < b)).drop("first")


def cut_out(packets: DataFrame, start: float, end: float) -> DataFrame:
    """Without [start, end)."""
    return packets.where(~((F.col("pts") >= int(start * SCALE)) & (F.col("pts") < int(end * SCALE))))


def concat(packets: DataFrame, order: Column) -> DataFrame:
    """All sources one after another by order: pts go on where the source before ends."""
    rows = packets.withColumn("ord", order)
    lengths = rows.groupBy("source", "ord").agg(F.max(F.col("pts") + F.col("duration")).alias("length"))
    before = F.coalesce(F.sum("length").over(W.orderBy("ord", "source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = lengths.select("source", before.alias("base"))
    return rows.join(bases, "source").withColumn("pts", F.col("pts") + F.col("base")).drop("ord", "base")


def segments(packets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Packets of (source, segment, start, end) ranges in seconds."""
    rows = packets.join(ranges, "source")
    return rows.where((F.col("pts") >= F.floor(F.col("start") * SCALE)) & (F.col("pts") < F.floor(F.col("end") * SCALE))).drop("start", "end")


def speed_up(packets: DataFrame, factor: float) -> DataFrame:
    """Keeps the packets at which a counter of 1/factor a packet reaches the next whole number."""
    n = F.col("i") + 1
    return packets.where(F.floor(n / F.lit(float(factor)) + F.lit(1e-9)) > F.floor((n - 1) / F.lit(float(factor)) + F.lit(1e-9)))


def slow_down(packets: DataFrame, factor: float) -> DataFrame:
    """Repeats each packet round(1/factor) times."""
    return packets.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(int(1 / factor + 0.5) - 1))))


def every_nth(packets: DataFrame, n: int, most: int = 0) -> DataFrame:
    rows = packets.where(F.col("i") % n == 0)
    return rows.where(F.floor(F.col("i") / n) < most) if most else rows


def thumbnail(packets: DataFrame, position: str | int = "middle") -> DataFrame:
    """The first, middle (count div 2), last or numbered packet of each source; numbers are clamped."""
    n = F.count(F.lit(1)).over(W.partitionBy("source"))
    at = {"first": F.lit(0), "middle": F.floor(n / 2), "last": n - 1}.get(position)
    at = F.least(F.lit(int(position)), n - 1) if at is None else at
    return packets.withColumn("at", at).where("i = at").drop("at")


def keyframe_at(packets: DataFrame, seconds: float) -> DataFrame:
    """The first keyframe at or after a time of each source: an as-of join forward, as one aggregate."""
    ok = packets.where(F.col("is_keyframe") & (F.col("pts") >= int(seconds * SCALE)))
    return ok.groupBy("source").agg(F.min("pts").alias("pts"), F.min_by("size", "pts").alias("size"))


def source_info(packets: DataFrame) -> DataFrame:
    return packets.groupBy("source").agg(F.count(F.lit(1)).alias("frames"), (F.max(F.col("pts") + F.col("duration")) / float(SCALE)).alias("duration"), F.sum(F.col("is_keyframe").cast("long")).alias("keyframes"), F.sum("size").alias("bytes"))


def fade_gain(packets: DataFrame, fps: float, fade_in: float, fade_out: float) -> DataFrame:
    """gain of each frame: up to 1 over fade_in seconds, down over the last fade_out."""
    t = F.col("i") / F.lit(float(fps))
    total = F.count(F.lit(1)).over(W.partitionBy("source")) / F.lit(float(fps))
    rise = F.when(t < fade_in, t / fade_in).otherwise(1.0) if fade_in else F.lit(1.0)
    fall = F.when(t > total - fade_out, (total - t) / fade_out).otherwise(1.0) if fade_out else F.lit(1.0)
    return packets.withColumn("gain", F.least(rise, fall))


def missing_frames(frames: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Numbers of a sequence without a frame, from its first to its last one: an anti-join with a generated range."""
    if first is None or last is None:
        low, high = frames.agg(F.min("frame_no"), F.max("frame_no")).first()
        first, last = low if first is None else first, high if last is None else last
    if first is None or last is None:
        return frames.select(F.col("frame_no").cast("long").alias("frame_no")).limit(0)
    wanted = frames.sparkSession.range(first, last + 1).withColumnRenamed("id", "frame_no")
    return wanted.join(frames, "frame_no", "left_anti")


def sequence_info(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.min("frame_no").alias("first"), F.max("frame_no").alias("last"), F.min_by("width", "frame_no").alias("width"), F.min_by("height", "frame_no").alias("height"))


def mismatched_frames(frames: DataFrame) -> DataFrame:
    """Frames of another size than the first one."""
    first = frames.agg(F.min_by("width", "frame_no").alias("w0"), F.min_by("height", "frame_no").alias("h0"))
    return frames.crossJoin(F.broadcast(first)).where("width <> w0 or height <> h0").drop("w0", "h0")


#: Numbers of a block, whose runs one window finds; only runs that touch a block's edge are joined across blocks.
BLOCK = 1 << 16


def contiguous_runs(frames: DataFrame) -> DataFrame:
    """Runs of frame numbers without a gap."""
    rows = frames.withColumn("block", F.floor(F.col("frame_no") / BLOCK))
    rows = rows.withColumn("island", F.col("frame_no") - F.row_number().over(W.partitionBy("block").orderBy("frame_no")))
    runs = rows.groupBy("block", "island").agg(F.min("frame_no").alias("first"), F.max("frame_no").alias("last"), F.count(F.lit(1)).alias("frames"))
    runs = runs.withColumn("edge", (F.col("first") == F.col("block") * BLOCK) | (F.col("last") == (F.col("block") + 1) * BLOCK - 1))
    order = W.orderBy("first")  # two rows a block at most
    edges = runs.where("edge").withColumn("new", F.coalesce((F.col("first") != F.lag("last").over(order) + 1).cast("int"), F.lit(1)))
    edges = edges.withColumn("run", F.sum("new").over(order)).groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("frames").alias("frames"))
    return runs.where("not edge").select("first", "last", "frames").unionByName(edges.drop("run"))


#: Equal steps from a key's least to its greatest value; only the step that holds the percentile is sorted.
STEPS = 4096


def p95(timings: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and 95th percentile: the sorted value at round((n - 1) * 0.95).

    Values are counted by steps, then those of the step in question by value, so no group meets in one task.
    """
    rows = timings.select(F.col(key).alias("k"), F.col(value).alias("v")).where("v is not null")
    stats = rows.groupBy("k").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    stats = stats.withColumn("at", F.floor((F.col("n") - 1) * 0.95 + 0.5))
    step = F.when(F.col("high") > F.col("low"), F.least(F.lit(STEPS - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * STEPS))).otherwise(0)
    keys = stats.select(F.col("k").alias("k2"), "mean", "at", "low", "high")
    rows = rows.join(keys, F.col("k").eqNullSafe(F.col("k2"))).select("k", "v", "mean", "at", step.alias("step"))
    order = W.partitionBy("k").orderBy("step")
    counts = rows.groupBy("k", "step", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("up", F.sum("n").over(order))
    chosen = counts.where("up > at and up - n <= at").select(F.col("k").alias("k2"), F.col("step").alias("s2"), (F.col("at") - F.col("up") + F.col("n")).alias("rest"))
    values = rows.join(chosen, F.col("k").eqNullSafe(F.col("k2")) & (F.col("step") == F.col("s2"))).groupBy("k", "mean", "rest", "v").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("up", F.sum("n").over(W.partitionBy("k").orderBy("v"))).where("up > rest")
    return values.groupBy("k", "mean").agg(F.min("v").alias("p95")).select(F.col("k").alias(key), "mean", "p95")
