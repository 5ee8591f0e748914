"""Analysis of images: measures within a row, without a shuffle; aggregates over the long form with one on image_id at most."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels import measures

#: Grades by least score.
GRADES = ((85, "A"), (70, "B"), (50, "C"), (25, "D"))
RECOMMENDATIONS = {
    "blurry": "use a faster shutter or a tripod, or sharpen",
    "noisy": "lower the ISO or denoise",
    "overexposed": "lower the exposure",
    "underexposed": "raise the exposure or brightness",
    "low_contrast": "raise the contrast",
    "oversaturated": "lower the saturation",
    "desaturated": "raise the saturation",
    "color_cast": "correct the white balance",
    "low_resolution": "use a higher resolution or upscale",
    "compression_artifacts": "use a higher quality setting or a lossless format",
}


def image_info(df: DataFrame) -> DataFrame:
    n = F.size("planes")
    kind = F.element_at(F.array(*map(F.lit, ("L8", "La8", "Rgb8", "Rgba8"))), n)
    return df.select("image_id", "w", "h", kind.alias("color_type"), n.alias("channels"), (n % 2 == 0).alias("has_alpha"))


def histogram(px: DataFrame, *channels: str) -> DataFrame:
    """image_id, channel, bin, n for the values that occur; partial counts before the shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("bin")) for c in channels or ("v",))))
    rows = px.select("image_id", pairs.alias("p")).select("image_id", "p.channel", "p.bin")
    return rows.groupBy("image_id", "channel", "bin").agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """The threshold of the greatest variance between classes, the first of equal ones; 0 for a uniform image."""
    w = W.partitionBy("image_id").orderBy("bin")
    every = W.partitionBy("image_id")
    sums = hist.withColumns({"wb": F.sum("n").over(w), "sb": F.sum(F.col("n") * F.col("bin")).over(w), "total": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("bin")).over(every)})
    wf = F.col("total") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.nullif(wf, F.lit(0))
    sums = sums.withColumn("variance", F.coalesce(F.round(F.col("wb").cast("double") * wf * gap * gap, 3), F.lit(0.0)))
    best = F.max_by("bin", F.struct("variance", -F.col("bin")))
    return sums.groupBy("image_id").agg(F.when(F.max("variance") > 0, best).otherwise(0).cast("int").alias("threshold"))


def tone(hist: DataFrame) -> DataFrame:
    """Entropy, median bin (the first with at least total div 2 up to it), first and last bin, mean, deviation."""
    w = W.partitionBy("image_id").orderBy("bin")
    p = F.col("n") / F.sum("n").over(W.partitionBy("image_id"))
    rows = hist.withColumns({"p": p, "up": F.sum("n").over(w), "total": F.sum("n").over(W.partitionBy("image_id"))})
    mean = F.sum(F.col("p") * F.col("bin"))
    return rows.groupBy("image_id").agg(
        F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"),
        F.min(F.when(F.col("up") >= F.floor(F.col("total") / 2), F.col("bin"))).alias("median_brightness"),
        F.min("bin").alias("low"),
        F.max("bin").alias("high"),
        F.round(mean, 6).alias("mean"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("p") * F.col("bin") * F.col("bin")) - mean * mean)), 6).alias("deviation"),
    )


def plane_values(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """(row, plane, place) of the rows given of a column of planes, all of one size."""
    return np.array(column.take(pa.array(rows)).flatten().flatten(), np.int64).reshape(len(rows), len(column[int(rows[0])]), -1)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def measured(df: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """image_id and what f gives for stacks of images of one size, as (n, h, w, channels); images never leave their row."""
    names, kinds = [part.split()[0] for part in schema.split(", ")], arrow_schema("image_id long, " + schema)

    def run(batches):
        for batch in batches:
            w, h = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            n = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for size in {*zip(w.tolist(), h.tolist(), n.tolist())}:
                rows = np.flatnonzero((w == size[0]) & (h == size[1]) & (n == size[2]))
                stack = plane_values(batch.column(3), rows).transpose(0, 2, 1).reshape(len(rows), size[1], size[0], -1)
                found = f(stack)
                values = [pa.array(found[name], kinds.field(name).type, from_pandas=True) for name in names]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *values], schema=kinds)

    rows = df.where("w > 0 and h > 0").select(F.col("image_id").cast("long"), F.col("w").cast("int"), F.col("h").cast("int"), "planes")
    return rows.mapInArrow(run, "image_id long, " + schema)


def laplacian(df: DataFrame) -> DataFrame:
    """The mean square of the 4-neighbour Laplacian of luma images over inner pixels."""
    out = measured(df, lambda x: {"laplacian": measures.laplacian(x[..., 0])}, "laplacian double")
    return out.withColumn("laplacian", F.round("laplacian", 6))


def edge_density(df: DataFrame) -> DataFrame:
    """The share of pixels, those at the border left out, that differ by over 30 from the right or lower one."""
    out = measured(df, lambda x: {"edge_density": measures.edge_density(x[..., 0])}, "edge_density double")
    return out.withColumn("edge_density", F.round("edge_density", 6))


def noise(px: DataFrame) -> DataFrame:
    """From the least variance of 8x8 blocks that begin before size - 8: 10 times its root, 100 at most or without a block."""
    inner = (F.floor(F.col("x") / 8) * 8 < F.col("w") - 8) & (F.floor(F.col("y") / 8) * 8 < F.col("h") - 8)
    block = px.groupBy("image_id", F.floor(F.col("x") / 8).alias("bx"), F.floor(F.col("y") / 8).alias("by"))
    block = block.agg(F.when(F.max(inner), F.avg((F.col("v") * F.col("v")).cast("double")) - F.avg(F.col("v").cast("double")) * F.avg(F.col("v").cast("double"))).alias("var"))
    return block.groupBy("image_id").agg(F.round(F.when(F.min("var").isNull(), 100.0).otherwise(F.least(F.lit(100.0), F.sqrt(F.greatest(F.lit(0.0), F.min("var"))) * 10)), 6).alias("noise"))


def color_metrics(px: DataFrame) -> DataFrame:
    """Mean HSV saturation in percent, and the entropy of hues (whole degrees of coloured pixels) over 8.5 in percent."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    span = (top - low).cast("double")
    sat = F.when(top > 0, span / top).otherwise(0.0)
    hue = F.when(F.col("r") == top, (F.col("g") - F.col("b")) / span).when(F.col("g") == top, 2 + (F.col("b") - F.col("r")) / span).otherwise(4 + (F.col("r") - F.col("g")) / span) * 60
    bin_ = F.when(span > 0, F.floor(F.when(hue < 0, hue + 360).otherwise(hue) + F.lit(1e-9)))
    rows = px.select("image_id", sat.alias("sat"), bin_.alias("hue")).groupBy("image_id", "hue").agg(F.count(F.lit(1)).alias("n"), F.sum("sat").alias("sat"))
    p = F.col("n") / F.sum(F.when(F.col("hue").isNotNull(), F.col("n"))).over(W.partitionBy("image_id"))
    rows = rows.withColumn("p", F.when(F.col("hue").isNotNull(), p))
    entropy = F.coalesce(-F.sum(F.col("p") * F.log2("p")), F.lit(0.0))
    return rows.groupBy("image_id").agg(F.round(F.sum("sat") / F.sum("n") * 100, 6).alias("saturation"), F.round(F.least(F.lit(100.0), entropy / 8.5 * 100), 6).alias("hue_variety"))


def color_cast(px: DataFrame, threshold: float = 15.0) -> DataFrame:
    """The tint that the channel means show, or null."""
    m = px.groupBy("image_id").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in "rgb"))
    return m.select("image_id", cast_name(threshold).alias("color_cast"))


def cast_name(threshold: float) -> Column:
    """The tint that the means r, g and b show, or null."""
    gray = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    over = lambda c: F.col(c) - gray > threshold
    return F.when(over("r"), "red").when(over("g"), "green").when(over("b"), "blue").when(gray - F.col("b") > threshold, "yellow").when(gray - F.col("r") > threshold, "cool/blue")


def artifacts(df: DataFrame) -> DataFrame:
    """Whether steps across the 8-pixel grid are over 1.3 times as large as others, in luma images of 32 pixels and more."""
    return measured(df, lambda x: {"artifacts": measures.artifacts(x[..., 0])}, "artifacts boolean")


def sharpness(v: Column) -> Column:
    return F.when(v < 100, v * 0.3).when(v < 500, 30 + 40 * (v - 100) / 400).when(v < 2000, 70 + 30 * (v - 500) / 1500).otherwise(100.0)


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, letter in GRADES[1:]:
        out = out.when(score >= least, letter)
    return out.otherwise("F")


def _quality(rgb: np.ndarray) -> dict[str, np.ndarray]:
    luma, mean = measures.luma(rgb), measures.means(rgb)
    return {
        "w": np.full(len(rgb), rgb.shape[2]),
        "h": np.full(len(rgb), rgb.shape[1]),
        **{k: v for k, v in measures.tone(luma).items() if k in ("low", "high", "mean", "deviation")},
        "laplacian": measures.laplacian(luma),
        "noise": measures.noise(luma),
        "artifacts": measures.artifacts(luma),
        **measures.colors(rgb),
        **{c: mean[:, k] for k, c in enumerate("rgb")},
    }


def quality(df: DataFrame) -> DataFrame:
    """Scores, grade and issues of each RGB image; all measures are taken in the image's own row, so nothing is shuffled."""
    out = measured(df, _quality, "w int, h int, low int, high int, mean double, deviation double, laplacian double, noise double, artifacts boolean, saturation double, hue_variety double, r double, g double, b double")
    out = out.withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "laplacian", "noise", "saturation", "hue_variety")})
    out = out.withColumn("color_cast", cast_name(15.0))
    first = F.when(F.col("low") >= 1, F.col("low")).otherwise(F.lit(1))
    out = out.withColumns({
        "sharpness": sharpness(F.col("laplacian")),
        "exposure": F.col("mean") / 255.0 * 100,
        "contrast": (F.least(F.lit(100.0), F.col("deviation") / 80.0 * 100) + (F.greatest(F.col("high") - first, F.lit(0)) / 255.0 * 100)) / 2.0,
        "color": (F.col("saturation") + F.col("hue_variety")) / 2.0,
    })
    score = 0.30 * F.col("sharpness") + 0.20 * (100 - F.col("noise")) + 0.20 * F.greatest(F.lit(0.0), 100 - 2 * F.abs(F.col("exposure") - 50)) + 0.15 * F.col("contrast") + 0.15 * F.col("color")
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    issues = [("blurry", F.col("sharpness") < 40), ("noisy", F.col("noise") > 60), ("overexposed", F.col("exposure") > 80), ("underexposed", F.col("exposure") < 20), ("low_contrast", F.col("contrast") < 30), ("oversaturated", F.col("saturation") > 85), ("desaturated", F.col("saturation") < 15), ("color_cast", F.col("color_cast").isNotNull()), ("low_resolution", (F.col("w") < 640) | (F.col("h") < 480)), ("compression_artifacts", F.col("artifacts"))]
    found = F.concat_ws(",", *(F.when(test, F.lit(name)) for name, test in issues))
    numbers = ("sharpness", "noise", "exposure", "contrast", "color", "score")
    return out.select("image_id", *(F.round(n, 4).alias(n) for n in numbers), grade(F.round("score", 4)).alias("grade"), found.alias("issues"))


#: Steps of a score's first sort, in hundredths of a point: as many rows at most go through one window.
STEPS = 100


def rank(report: DataFrame) -> DataFrame:
    """Reports with their place by score, ties by image_id.

    Places are those within a step of the score and those of all higher steps, which are counted; so one task orders a step's
    rows and only the counts of at most 10,001 steps meet in one.
    """
    rows = report.withColumn("step", F.floor(F.col("score") * STEPS))
    above = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("step").agg(F.count(F.lit(1)).alias("n")).select("step", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    inside = F.row_number().over(W.partitionBy("step").orderBy(F.desc("score"), "image_id"))
    return rows.withColumn("inside", inside).join(F.broadcast(counts), "step").withColumn("place", (F.col("inside") + F.col("above")).cast("long")).drop("step", "inside", "above")


def best(report: DataFrame, n: int = 1) -> DataFrame:
    return report.orderBy(F.desc("score"), "image_id").limit(n)


def recommendations(report: DataFrame) -> DataFrame:
    texts = F.create_map(*(F.lit(x) for pair in RECOMMENDATIONS.items() for x in pair))
    return report.withColumn("recommendations", F.transform(F.filter(F.split("issues", ","), lambda i: i != ""), lambda i: texts[i]))


def _pairs(left: DataFrame, right: DataFrame, f: Callable[[np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """f of the planes, as (channels, pixels), of images of one id and size: one join of images, not of pixels."""
    right = right.select("image_id", F.col("w").alias("w2"), F.col("h").alias("h2"), F.col("planes").alias("other"))
    rows = left.join(right, "image_id").where("w = w2 and h = h2 and size(planes) = size(other)").select("image_id", "planes", "other")
    kinds = arrow_schema("image_id long, " + schema)

    def run(batches):
        for batch in batches:
            found = [f(plane_values(batch.column(1), np.array([k]))[0], plane_values(batch.column(2), np.array([k]))[0]) for k in range(batch.num_rows)]
            columns = zip(*found) if found else [[]] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds.field(k + 1).type) for k, c in enumerate(columns))], schema=kinds)

    return rows.mapInArrow(run, "image_id long, " + schema)


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean square error, PSNR (null where equal), differing pixels and greatest difference of images of one id and size."""
    out = _pairs(left, right, lambda a, b: (measures.differences(a, b)[0] / a.size, *measures.differences(a, b)[1:]), "mse double, differing long, max_delta int")
    psnr = F.when(F.col("mse") > 0, 10 * F.log10(F.lit(255.0 * 255.0) / F.col("mse")))
    return out.select("image_id", F.round("mse", 6).alias("mse"), F.round(psnr, 6).alias("psnr"), "differing", "max_delta")


def global_ssim(left: DataFrame, right: DataFrame) -> DataFrame:
    """SSIM of whole luma images in one window, with sample variances."""
    out = _pairs(left, right, lambda a, b: (measures.ssim(a[0], b[0]),), "ssim double")
    return out.select("image_id", F.round("ssim", 6).alias("ssim"))


#: Frame numbers of a block, whose frames one window orders; only a block's last frame is seen by the next block.
BLOCK = 1024


def scene_changes(frames: DataFrame, threshold: float) -> DataFrame:
    """Frames (frame_no, w, h, planes of RGB) that differ from the one before: every 8th pixel, mean difference over 255."""
    w = F.col("w")
    places = F.filter(F.sequence(F.lit(0), w * F.col("h") - 1), lambda i: (i % w % 8 == 0) & (F.floor(i / w) % 8 == 0))
    small = frames.select("frame_no", F.transform("planes", lambda p: F.transform(places, lambda i: F.get(p, i))).alias("p"), F.floor(F.col("frame_no") / BLOCK).alias("block"))
    last = small.groupBy("block").agg(F.max("frame_no").alias("frame_no"), F.max_by("p", "frame_no").alias("p"))
    after = last.select("block").withColumn("next", F.lead("block").over(W.orderBy("block"))).where("next is not null")
    edges = last.join(after, "block").select("frame_no", "p", F.col("next").alias("block"))
    rows = small.withColumn("own", F.lit(True)).unionByName(edges.withColumn("own", F.lit(False)))
    pairs = rows.withColumn("before", F.lag("p").over(W.partitionBy("block").orderBy("frame_no"))).where("own and before is not null")
    diff = F.aggregate(F.flatten(F.zip_with("p", "before", lambda a, b: F.zip_with(a, b, lambda u, v: F.abs(u - v)))), F.lit(0).cast("bigint"), lambda s, v: s + v)
    share = diff / F.size(F.flatten("p")) / 255.0
    return pairs.select("frame_no", F.round(share, 6).alias("difference"), (share > threshold).alias("scene_change"))


def adaptive_binarize(df: DataFrame, thresholds: DataFrame, block: int = 31) -> DataFrame:
    """255 above the mean of the local mean and the image's Otsu threshold, less 5; else 0."""
    from .neighbourhood import box_mean

    means = box_mean(df, block // 2).select("image_id", F.col("planes")[0].alias("mean"))
    rows = df.join(means, "image_id").join(thresholds, "image_id")
    level = lambda i: F.greatest(F.lit(0), F.floor((F.floor(F.get(F.col("mean"), i) + F.lit(1e-9)) + F.col("threshold")) / 2) - 5)
    out = F.transform(F.col("planes")[0], lambda v, i: F.when(v > level(i), 255).otherwise(0))
    return rows.select("image_id", "w", "h", F.array(out).alias("planes"))


def skew_angle(edges: DataFrame, threshold: int = 0, step: int = 1) -> DataFrame:
    """The angle from -90 to 89 whose Hough line gathers most of the pixels above threshold, and its share of them.

    Votes are counted in the image's own row. Images without such a pixel have no row.
    compat: engines that leave rho out always find 0.
    """

    def vote(stack: np.ndarray) -> dict[str, np.ndarray]:
        found = np.array([measures.hough(image > threshold, step) for image in stack[..., 0]])
        return {"angle": found[:, 0], "votes": found[:, 1], "total": found[:, 2]}

    out = measured(edges, vote, "angle int, votes long, total long").where("total > 0")
    return out.select("image_id", "angle", "votes", F.round(F.col("votes") / F.col("total"), 6).alias("confidence"))
