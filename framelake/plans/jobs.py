"""Job specs: a JSON document becomes a DataFrame plan over images, packets or clips, and run() writes its files.

plan() gives the rows that a job would write; run() writes them and says so only when all files are there.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W

from ..functions import color
from ..kernels import codecs, containers
from ..operators import annotate, geometry, neighbourhood, timeline

#: Operations on images, on packets, and on clips; those with one output file name it, others name a folder.
IMAGES = ("filter", "convert", "text", "remove_bg", "gif", "encode")
PACKETS = ("transcode", "trim", "concat", "frames", "thumbnail", "extract_audio", "info")
OPERATIONS = (*IMAGES, *PACKETS, "audio_encode")


@dataclass
class Trim:
    start: float = 0.0
    end: float = 0.0


@dataclass
class Frames:
    every: int = 1
    max_frames: int = 0
    format: str = "png"


@dataclass
class JobSpec:
    operation: str
    inputs: list[str] = field(default_factory=list)
    output: str | None = None
    transforms: list[str] = field(default_factory=list)
    trim: Trim | None = None
    frames: Frames | None = None
    fps: float = 0.0
    speed: float = 1.0
    format: str | None = None
    text: dict | None = None
    model: str | None = None
    position: str | int = "middle"

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {self.operation}")

    @classmethod
    def parse(cls, source: str) -> JobSpec:
        """From JSON text, or from the path of a JSON file."""
        data = json.loads(source if source.lstrip().startswith("{") else Path(source).read_text())
        unknown = set(data) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        data["trim"] = Trim(**data["trim"]) if data.get("trim") else None
        data["frames"] = Frames(**data["frames"]) if data.get("frames") else None
        return cls(**data)

    @classmethod
    def template(cls, operation: str) -> str:
        spec = cls(operation, inputs=["input"], output="output", trim=Trim() if operation in ("trim", "transcode") else None, frames=Frames() if operation == "frames" else None, text={"text": "Hello", "x": 10, "y": 10, "size": 24} if operation == "text" else None, model="model.onnx" if operation == "remove_bg" else None)
        return json.dumps(asdict(spec), indent=2)


def _number(text: str) -> float:
    return float(text)


def adjust_planes(df: DataFrame, f, *args) -> DataFrame:
    """A colour function on planes: pixel-wise over the zipped planes, without a shuffle."""
    names = {1: ("v",), 2: ("v", "a"), 3: ("r", "g", "b"), 4: ("r", "g", "b", "a")}
    first = F.size("planes")
    out = None
    for n, keys in names.items():
        zipped = F.arrays_zip(*(F.get("planes", F.lit(k)).alias(name) for k, name in enumerate(keys)))
        if keys[0] == "v" and f in (color.saturation, color.hue, color.temperature, color.tint, color.vibrance):
            pixel = F.col("planes")
        else:
            pixel = _pixelwise(zipped, keys, f, args)
        out = F.when(first == n, pixel) if out is None else out.when(first == n, pixel)
    return df.withColumn("planes", out)


def _pixelwise(zipped, keys, f, args):
    mapped = F.transform(zipped, lambda p: F.array(*_ordered(f({k: p[k] for k in keys}, *args))))
    n = len(_probe(f, keys, args))
    return F.array(*(_plane(mapped, k) for k in range(n)))


def _probe(f, keys, args):
    return _ordered(f({k: F.lit(0) for k in keys}, *args))


def _ordered(channels):
    return [channels[k].cast("int") for k in ("v", "r", "g", "b", "a") if k in channels]


def _plane(mapped, k: int):
    return F.transform(mapped, lambda p: p[k])


#: Image transforms of a job, by the name before the colon.
TRANSFORMS = {
    "rotate": lambda df, v: geometry.rotate(df, _number(v)),
    "flip": lambda df, v: {"h": geometry.flip_horizontal, "v": geometry.flip_vertical, "both": geometry.flip_both}[v](df),
    "crop": lambda df, v: geometry.crop(df, *(int(x) for x in v.split(","))),
    "resize": lambda df, v: geometry.resize(df, *(int(x) for x in v.split("x"))),
    "blur": lambda df, v: neighbourhood.gaussian_blur(df, _number(v)),
    "sharpen": lambda df, v: neighbourhood.unsharp_mask(df, _number(v), 0),
    "denoise": lambda df, v: neighbourhood.denoise(df, int(v)),
    **{n: (lambda df, v, n=n: adjust_planes(df, getattr(color, n), _number(v))) for n in ("brightness", "contrast", "saturation", "hue", "exposure", "gamma", "temperature", "tint", "vibrance")},
    **{n: (lambda df, v, n=n: adjust_planes(df, getattr(color, n))) for n in ("grayscale", "sepia", "invert")},
    **{n: (lambda df, v, n=n: adjust_planes(df, getattr(color, n), int(v))) for n in ("posterize", "solarize")},
}


class Pipeline:
    """Image transforms in a row; executing one adds to the plan, so Catalyst sees all of them at once."""

    def __init__(self, transforms: list[str] | None = None):
        self.steps = []
        for text in transforms or []:
            name, _, value = text.partition(":")
            if name not in TRANSFORMS:
                raise ValueError(f"unknown transform {name}")
            self.add(lambda df, f=TRANSFORMS[name], v=value: f(df, v))

    def add(self, step) -> Pipeline:
        self.steps.append(step)
        return self

    def execute(self, images: DataFrame) -> DataFrame:
        for step in self.steps:
            images = images.transform(step)
        return images


def plan(spark: SparkSession, spec: JobSpec, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """The DataFrame of a job. inputs gives images, packets or clips by name; other names are read as files.

    Image operations give image_id, w, h, planes and name; frames and thumbnail give pictures in compact form; trim, concat
    and transcode give packets of the first video stream; info gives a row for each source.
    """
    from .. import sources
    from ..sources import containers as media
    from ..sources import files

    inputs = inputs or {}

    def images(name: str) -> DataFrame:
        if name in inputs:
            return inputs[name].withColumn("name", F.col("image_id").cast("string"))
        compact = sources.read_images(spark, name)
        names = compact.where("error is null").select(F.xxhash64("path").alias("image_id"), F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("name"), "path")
        twin = F.row_number().over(W.partitionBy("name").orderBy("path"))
        names = names.select("image_id", F.when(twin > 1, F.concat("name", F.lit("-"), twin.cast("string"))).otherwise(F.col("name")).alias("name"))
        return sources.images(compact).join(names, "image_id")

    def packets(name: str) -> DataFrame:
        if name in inputs:
            return inputs[name]
        sources.register(spark)
        rows = spark.read.format("media_packets").load(name)
        return rows if spec.operation == "extract_audio" else rows.where("kind = 'vids'")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    if not spec.inputs or spec.operation == "concat" and len(spec.inputs) < 2:
        raise ValueError("too few inputs")
    if spec.operation == "audio_encode":
        return union([inputs[n] if n in inputs else sources.read_audio(spark, n) for n in spec.inputs])
    if spec.operation in IMAGES:
        out = union([images(n) for n in spec.inputs])
        names = out.select("image_id", "name")
        out = Pipeline(spec.transforms).execute(out)
        if spec.operation == "text":
            settings = dict(spec.text or {})
            if not settings.get("text"):
                raise ValueError("text settings are missing")
            settings["color"] = tuple(settings.get("color", (255, 255, 255)))
            out = annotate.draw_text(out, settings.pop("text"), **settings)
        if spec.operation == "remove_bg":
            from . import models

            if not spec.model:
                raise ValueError("a model is missing")
            out = models.remove_background(out, models.load_model(spec.model))
        if "name" not in out.columns:
            out = out.join(names, "image_id")
        return out
    if spec.operation == "concat":
        out = union([packets(name).withColumn("ord", F.lit(k)) for k, name in enumerate(spec.inputs)])
        return timeline.concat(out, F.col("ord"))
    out = union([packets(n) for n in spec.inputs])
    if spec.operation == "info":
        return timeline.source_info(out)
    if spec.operation == "extract_audio":
        return files.audio_of(out)
    if spec.operation in ("frames", "thumbnail"):
        f = spec.frames or Frames()
        out = timeline.every_nth(out, f.every, f.max_frames) if spec.operation == "frames" else timeline.thumbnail(out, spec.position)
        return media.frames(out) if "data" in out.columns else out
    if spec.operation == "trim" and spec.trim is None:
        raise ValueError("trim settings are missing")
    if spec.trim:
        out = timeline.trim(out, spec.trim.start, spec.trim.end or 1e12)
    if spec.speed > 1:
        out = timeline.speed_up(out, spec.speed)
    elif 0 < spec.speed < 1:
        out = timeline.slow_down(out, spec.speed)
    return out


def retimed(packets: DataFrame, speed: float) -> DataFrame:
    """Packets of a faster or slower stream with times of their own: from 0, evenly, a packet's duration apart."""
    order = W.partitionBy("source").orderBy("dts", *(["copy"] if "copy" in packets.columns else []))
    at = ((F.row_number().over(order) - 1) * F.col("duration")).cast("long")
    return packets.withColumns({"pts": at, "dts": at, "i": F.row_number().over(order).cast("long") - 1}).drop("copy") if speed != 1 else packets


def rebased(packets: DataFrame) -> DataFrame:
    """Packets whose least dts is 0."""
    first = F.min("dts").over(W.partitionBy("source"))
    return packets.withColumns({"pts": F.col("pts") - first, "dts": F.col("dts") - first})


def one_file(images: DataFrame, path: str, make) -> DataFrame:
    """A file that make builds of all images in order of name, in one task, as it is one file: path, images, bytes."""
    from ..sources.containers import write_whole

    def run(batches):
        rows = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda r: r["name"])
        if rows:
            data = make([np.array(r["planes"], np.uint8).T.reshape(r["h"], r["w"], -1) for r in rows])
            write_whole(path, data)
            yield pa.RecordBatch.from_pylist([{"path": path, "images": len(rows), "bytes": len(data)}])

    return images.select("name", "w", "h", "planes").repartition(1).mapInArrow(run, "path string, images long, bytes long")


def write(spark: SparkSession, spec: JobSpec, inputs: dict[str, DataFrame] | None = None) -> list[str]:
    """Writes a job's files and gives their paths; rows that can't be written are an error, after the others are."""
    from ..sources import containers as media
    from ..sources import files

    rows = plan(spark, spec, inputs)
    if spec.operation == "info":
        found = [r.asDict() for r in rows.collect()]
        if spec.output:
            media.write_whole(spec.output, "\n".join(json.dumps(r) for r in found).encode())
        return [spec.output] if spec.output else []
    if not spec.output:
        raise ValueError("the output is missing")
    folder = spec.output if "://" in spec.output else f"file://{spec.output}"
    kind = (spec.format or (spec.frames.format if spec.frames else None) or "png").lower()
    made, bad = None, 0
    if spec.operation == "gif":
        delay = round(1000 / (spec.fps or 10))
        made = one_file(rows, spec.output, lambda frames: codecs.write_gif([f[..., :3] if f.shape[2] > 2 else np.repeat(f[..., :1], 3, 2) for f in frames], delay))
    elif spec.operation == "encode":
        rate = round((spec.fps or 30) * 1000)
        made = one_file(rows, spec.output, lambda frames: containers.h264_mp4([even(f) for f in frames], rate, 1000))
    elif spec.operation in IMAGES:
        if "error" in rows.columns:
            bad = rows.where("error is not null").count()
            rows = rows.where("error is null")
        encoded = files.encode_images(rows, kind)
        made = files.write_files(encoded.join(rows.select("image_id", F.concat("name", F.lit(f".{kind}")).alias("name")), "image_id"), folder)
    elif spec.operation in ("frames", "thumbnail"):
        bad = rows.where("error is not null").count()
        stem = F.concat(F.regexp_extract("source", r"([^/]*?)(\.[^./]*)?$", 1), F.lit("_"), F.lpad(F.col("i").cast("string"), 6, "0"), F.lit(f".{kind}"))
        encoded = files.encode_compact(rows.withColumn("path", stem), kind)
        made = files.write_files(encoded.withColumnRenamed("path", "name"), folder)
    elif spec.operation in ("extract_audio", "audio_encode"):
        kind = (spec.format or "wav").lower()
        if "error" in rows.columns:
            bad = rows.where("error is not null").count()
            rows = rows.where("error is null")
        made = files.write_files(files.encode_audio(rows.withColumnRenamed("path", "source"), kind), folder)
    else:
        if spec.operation == "concat":
            rows = rows.withColumns({"dts": F.col("pts"), "source": F.lit("joined")})
        made = media.write_container(retimed(rebased(rows), spec.speed), spec.output)
    done = [r[0] for r in made.collect()]
    if bad:
        raise ValueError(f"{bad} rows could not be written, {len(done)} were")
    if not done:
        raise ValueError("nothing was found to write")
    return [d if "/" in d else f"{spec.output}/{d}" for d in done]


def even(image: np.ndarray) -> np.ndarray:
    """RGB with even sides: the last row or column goes."""
    image = image[: image.shape[0] // 2 * 2, : image.shape[1] // 2 * 2]
    return image[..., :3] if image.shape[2] > 2 else np.repeat(image[..., :1], 3, 2)


def run(spark: SparkSession, source: str, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Runs a job and gives its result row: operation, success (all its files are written), error, outputs."""
    operation, error, outputs = None, None, []
    try:
        spec = JobSpec.parse(source)
        operation = spec.operation
        outputs = write(spark, spec, inputs)
    except Exception as e:  # noqa: BLE001  a failed job is a result
        error = f"{type(e).__name__}: {e}"[:500]
    return spark.createDataFrame([(operation, error is None, error, outputs)], "operation string, success boolean, error string, outputs array<string>")
