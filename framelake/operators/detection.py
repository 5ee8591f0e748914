"""Detections, poses, recognised text and model outputs as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binding import let


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    both = w * h
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def iou_pairs(boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of overlapping boxes of one image; an image has few boxes."""
    box = F.struct("x1", "y1", "x2", "y2")
    a = boxes.select("image_id", F.col("det_id").alias("a"), box.alias("p"))
    b = boxes.select("image_id", F.col("det_id").alias("b"), box.alias("q"))
    pairs = a.join(b, "image_id").where("a < b").withColumn("iou", F.round(iou(F.col("p"), F.col("q")), 6))
    return pairs.where(F.col("iou") > least).select("image_id", "a", "b", "iou")


def nms(boxes: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Greedy suppression: the best box stays, boxes with an overlap of threshold or more go, and so on.

    A fold over an image's boxes in order of score, in the JVM; an image's boxes make one row, as they are few.
    """
    names = boxes.columns
    grouped = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), F.col("det_id").alias("tie"), F.struct(*names).alias("box")))).alias("all"))
    ordered = F.transform("all", lambda b: b["box"])
    keep = F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) >= threshold), kept).otherwise(F.array_append(kept, b)))
    return grouped.select(F.explode(keep).alias("b")).select(*(F.col(f"b.{n}").alias(n) for n in names))


def softmax_top(df: DataFrame, scores: Column, n: int) -> DataFrame:
    """The n greatest softmax probabilities (id, rank, label, p); of equal ones the last label, as an argmax by >= finds."""
    shifted = let(F.array_max(scores), lambda top: F.transform(scores, lambda v: F.exp(v.cast("double") - top.cast("double"))))
    shares = let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v, i: F.struct((v / total).alias("p"), i.alias("label")))))
    ranked = F.slice(F.sort_array(shares, asc=False), 1, n)
    rows = df.select("id", F.posexplode(ranked).alias("rank", "r"))
    return rows.select("id", "rank", F.col("r.label").alias("label"), F.round("r.p", 6).alias("p"))


def ctc_collapse(steps: DataFrame, blank: int) -> DataFrame:
    """Greedy decoding of (id, pos, token): repeats fall together, blanks go."""
    w = W.partitionBy("id").orderBy("pos")
    kept = steps.withColumn("before", F.lag("token").over(w)).where((F.col("token") != blank) & (F.col("before").isNull() | (F.col("before") != F.col("token"))))
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("tokens"))


def joint_angle(a: Column, b: Column, c: Column) -> Column:
    """Degrees at b between a and c (structs x, y)."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    n = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(n > 1e-10, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / n)))))


def facing(p: dict[str, Column], least: float = 0.3) -> Column:
    """front, back, left, right or unknown from nose, eyes and shoulders (structs x, y, confidence)."""
    ls, rs, nose = p["left_shoulder"], p["right_shoulder"], p["nose"]
    known = (ls["confidence"] >= least) & (rs["confidence"] >= least) & (nose["confidence"] >= least)
    width, off = F.abs(rs["x"] - ls["x"]), nose["x"] - (ls["x"] + rs["x"]) / 2.0
    side = F.when(off > 0, "right").otherwise("left")
    eyes = (p["left_eye"]["confidence"] >= least) & (p["right_eye"]["confidence"] >= least)
    return F.when(~known, "unknown").when(width < 0.05, side).when(F.abs(off) < 0.3 * width, F.when(eyes, "front").otherwise("back")).otherwise(side)


def pose_bounds(keypoints: DataFrame, least: float = 0.3) -> DataFrame:
    ok = keypoints.where(F.col("confidence") >= least)
    return ok.groupBy("image_id", "person").agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))


def order_quad(corners: Column) -> Column:
    """Top left, top right, bottom right, bottom left of four points, by the sums and differences of their places."""
    by = lambda key, last: F.element_at(F.array_sort(F.transform(corners, lambda p: F.struct(key(p).alias("k"), p.alias("p")))), -1 if last else 1)["p"]
    total, diff = (lambda p: p["x"] + p["y"]), (lambda p: p["x"] - p["y"])
    return F.array(by(total, False), by(diff, True), by(total, True), by(diff, False))


def age_range(age: Column) -> Column:
    low = (F.floor(age / 5) * 5).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string"))


def depth_gray(df: DataFrame) -> DataFrame:
    """Depth values (depth array) stretched to 0..255, cut; constant depths are 0."""
    stretched = lambda b: F.transform("depth", lambda v: F.when(b["high"] > b["low"], F.floor((v - b["low"]) / (b["high"] - b["low"]) * 255.0)).otherwise(0).cast("int"))
    return df.withColumn("gray", let(F.struct(F.array_min("depth").alias("low"), F.array_max("depth").alias("high")), stretched))


def token_segments(tokens: DataFrame, end: int = 50257, first_time: int = 50364, step: float = 0.02) -> DataFrame:
    """Transcript segments of (clip_id, pos, token): time tokens open and close them, text is the ids in brackets."""
    w = W.partitionBy("clip_id").orderBy("pos")
    stop = F.min(F.when(F.col("token") == end, F.col("pos"))).over(W.partitionBy("clip_id"))
    rows = tokens.withColumn("stop", stop).where("stop is null or pos < stop")
    time = F.when(F.col("token") >= first_time, (F.col("token") - first_time) * step)
    rows = rows.withColumn("time", time).withColumn("group", F.count("time").over(w)).withColumn("start", F.last("time", True).over(w))
    words = rows.where("time is null").groupBy("clip_id", "group").agg(F.max("start").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    ends = rows.where("time is not null").select("clip_id", (F.col("group") - 1).alias("group"), F.col("time").alias("end"))
    out = words.join(ends, ["clip_id", "group"], "left")
    return out.select("clip_id", F.coalesce("start", F.lit(0.0)).alias("start"), "end", F.array_join(F.transform("t", lambda p: F.concat(F.lit("["), p["token"].cast("string"), F.lit("]"))), "").alias("text"))
