"""Whole files as rows: the reading is Spark's binaryFile source, the decoding an Arrow kernel; files of any store do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timecode
from ..kernels import codecs, containers, jpeg

IMAGE = "path string, w int, h int, channels int, data binary, error string"
AUDIO = "path string, sample_rate int, channels int, samples array<double>, error string"
DECODERS = {"png": codecs.read_png, "bmp": codecs.read_bmp, "ppm": codecs.read_ppm, "pgm": codecs.read_ppm, "jpg": jpeg.read_jpeg, "jpeg": jpeg.read_jpeg}
ENCODERS = {"png": codecs.write_png, "bmp": codecs.write_bmp, "ppm": codecs.write_ppm, "gif": lambda image: codecs.write_gif([image]), "jpg": jpeg.write_jpeg, "jpeg": jpeg.write_jpeg}


def _binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def decode_image(data: bytes) -> np.ndarray:
    for magic, kind in ((codecs.PNG_MAGIC, "png"), (b"BM", "bmp"), (b"P5", "ppm"), (b"P6", "ppm"), (b"\xff\xd8\xff", "jpeg")):
        if data.startswith(magic):
            return DECODERS[kind](data)
    raise ValueError("unsupported image format")


#: The fields of an image in compact form, in Arrow.
IMAGE_FIELDS = [("w", pa.int32()), ("h", pa.int32()), ("channels", pa.int32()), ("data", pa.binary()), ("error", pa.string())]


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """PNG, JPEG, BMP and PPM files in compact form; a file that can't be read has its error instead."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    image = decode_image(data)
                    row = {"path": name, "w": image.shape[1], "h": image.shape[0], "channels": image.shape[2], "data": image.tobytes(), "error": None}
                except Exception as error:  # noqa: BLE001  a bad file is a result
                    row = {"path": name, "w": None, "h": None, "channels": None, "data": None, "error": str(error)}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), *IMAGE_FIELDS]))

    return _binary(spark, path, glob).select("path", "content").mapInArrow(run, IMAGE)


def read_photos(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,JPG,JPEG}") -> DataFrame:
    """JPEG files in compact form, decoded by Spark's image source in the JVM; many times as fast as read_images.

    Files that the JVM can't decode (CMYK, damaged ones) have an error, and read_images may still read them.
    """
    rows = spark.read.format("image").option("pathGlobFilter", glob).option("dropInvalid", False).load(path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                channels, data = row["channels"], row["data"]
                if row["w"] < 1:
                    row |= {"w": None, "h": None, "channels": None, "data": None, "error": "not decoded"}
                elif channels >= 3:
                    pixels = np.frombuffer(data, np.uint8).reshape(-1, channels)
                    row["data"] = pixels[:, [2, 1, 0, 3][:channels]].tobytes()
                yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), *IMAGE_FIELDS]))

    fields = {"origin": "path", "width": "w", "height": "h", "nChannels": "channels", "data": "data"}
    return rows.select(*(F.col(f"image.{k}").alias(v) for k, v in fields.items()), F.lit(None).cast("string").alias("error")).mapInArrow(run, IMAGE)


def images(compact: DataFrame) -> DataFrame:
    """Images as rows of planes from the compact form, with path as image_id's source; numbered by a hash of the path."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["error"] is None:
                    image = np.frombuffer(row["data"], np.uint8).reshape(-1, row["channels"])
                    rows.append({"image_id": row["image_id"], "w": row["w"], "h": row["h"], "planes": [image[:, k].astype(np.int32).tolist() for k in range(row["channels"])]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("image_id", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("planes", pa.list_(pa.list_(pa.int32())))]))

    return compact.withColumn("image_id", F.xxhash64("path")).mapInArrow(run, "image_id long, w int, h int, planes array<array<int>>")


def map_images(compact: DataFrame, f, threads: int = 1) -> DataFrame:
    """Images in compact form through a kernel of (h, w, c) uint8 arrays, such as those of kernels.image; errors stay and become rows."""
    names = compact.columns

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["error"] is None:
                    try:
                        image = f(np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"], row["channels"]))
                        row |= {"w": image.shape[1], "h": image.shape[0], "channels": image.shape[2], "data": np.ascontiguousarray(image).tobytes()}
                    except Exception as error:  # noqa: BLE001  a bad image is a result
                        row |= {"w": None, "h": None, "channels": None, "data": None, "error": f"{type(error).__name__}: {error}"[:300]}
                yield pa.RecordBatch.from_pylist([row], batch.schema)

    return compact.select(*names).mapInArrow(run, compact.schema)


def encode_compact(compact: DataFrame, kind: str) -> DataFrame:
    """path and the encoded file of images in compact form; rows with an error go."""
    if kind not in ENCODERS:
        raise ValueError(f"unsupported format {kind}")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"], row["channels"])
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([ENCODERS[kind](image)], pa.binary())], ["path", "content"])

    return compact.where("error is null").mapInArrow(run, "path string, content binary")


def read_audio(spark: SparkSession, path: str, glob: str = "*.{wav,flac}") -> DataFrame:
    """WAV and FLAC files; a file that can't be read has its error instead."""
    def run(batches):
        schema = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float64())), ("error", pa.string())])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rate, channels, samples = containers.read_flac(data) if data[:4] == b"fLaC" else codecs.read_wav(data)
                    row = {"path": name, "sample_rate": rate, "channels": channels, "samples": samples.tolist(), "error": None}
                except Exception as error:  # noqa: BLE001
                    row = {"path": name, "sample_rate": None, "channels": None, "samples": None, "error": str(error)}
                yield pa.RecordBatch.from_pylist([row], schema)

    return _binary(spark, path, glob).select("path", "content").mapInArrow(run, AUDIO)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT, VTT and ASS files; track_id is the path."""
    from ..operators import subtitles

    files = _binary(spark, path).where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin("srt", "vtt", "ass", "ssa"))
    return subtitles.load(files.select(F.col("path").alias("track_id"), "path", F.decode("content", "UTF-8").alias("content")))


def numbered(spark: SparkSession, pattern: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Files of a numbered sequence (%d and %04d pad to 4, %06d to 6, {} does not): frame_no, path, content."""
    import re

    folder, _, name = pattern.rpartition("/")
    m = re.search(r"%(?:0?(\d+))?d|\{\}", name)
    if not m:
        raise ValueError("the pattern has no number")
    digits = "[0-9]+" if m[0] == "{}" else f"[0-9]{{{int(m[1] or 4)},}}"
    shape = re.compile(re.escape(name[: m.start()]) + f"({digits})" + re.escape(name[m.end() :]) + "$")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    listed = [(int(found[1]), f.path) for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.is_file and (found := shape.match(f.base_name))]
    chosen = [(n, at) for n, at in listed if (start is None or n >= start) and (end is None or n <= end)]
    schema = "frame_no long, path string, content binary"
    if not chosen:
        return spark.createDataFrame([], schema)
    scheme = folder.partition("://")[0] + "://" if "://" in folder else "file://"
    # only the chosen files are read
    rows = spark.read.format("binaryFile").load([scheme + at for _, at in chosen])
    number = F.regexp_extract("path", shape.pattern, 1).cast("bigint")
    return rows.select(number.alias("frame_no"), "path", "content")


def encode_images(df: DataFrame, kind: str) -> DataFrame:
    """image_id and the encoded file of images in compact or plane form."""
    if kind not in ENCODERS:
        raise ValueError(f"unsupported format {kind}")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                image = np.array(row["planes"], np.uint8).T.reshape(row["h"], row["w"], -1)
                out.append(ENCODERS[kind](image))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["image_id", "content"])

    return df.select("image_id", "w", "h", "planes").mapInArrow(run, "image_id long, content binary")


def encode_wav(df: DataFrame, rate: int, channels: int = 1, bits: int = 16, floating: bool = False) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [codecs.write_wav(np.array(s or [], float), rate, channels, bits, floating) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["clip_id", "content"])

    return df.select("clip_id", "samples").mapInArrow(run, "clip_id long, content binary")


def encode_flac(df: DataFrame, rate: int, channels: int = 1, bits: int = 16) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [containers.write_flac(np.array(s or [], float), rate, channels, bits) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["clip_id", "content"])

    return df.select("clip_id", "samples").mapInArrow(run, "clip_id long, content binary")


def encode_audio(clips: DataFrame, kind: str) -> DataFrame:
    """name and content of clips (source, sample_rate, channels, samples) as WAV or FLAC files."""
    makers = {"wav": codecs.write_wav, "flac": containers.write_flac}
    if kind not in makers:
        raise ValueError(f"unsupported audio format {kind}")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = makers[kind](np.array(row["samples"] or [], float), row["sample_rate"], row["channels"])
                name = row["source"].rpartition("/")[2].rpartition(".")[0] or row["source"]
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.{kind}"]), pa.array([data], pa.binary())], ["name", "content"])

    return clips.select("source", "sample_rate", "channels", "samples").mapInArrow(run, "name string, content binary")


def audio_of(packets: DataFrame) -> DataFrame:
    """The plain PCM audio of containers as one clip for each source: source, hz, channels, samples."""
    rows = packets.where("kind = 'auds'").groupBy("source", "stream_index", "hz", "channels").agg(F.array_sort(F.collect_list(F.struct("dts", "i", "data"))).alias("parts"))

    def run(batches):
        kinds = pa.schema([("source", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float64()))])
        for batch in batches:
            for row in batch.to_pylist():
                raw = b"".join(p["data"] for p in row["parts"])
                values = np.frombuffer(raw, "<i2", len(raw) // 2) / 32767.0
                yield pa.RecordBatch.from_pylist([{"source": row["source"], "sample_rate": row["hz"], "channels": row["channels"], "samples": values.tolist()}], kinds)

    return rows.mapInArrow(run, "source string, sample_rate int, channels int, samples array<double>")


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes a file for each row, whole or not at all; gives name and bytes. folder is one that all executors share."""

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_output_stream(f"{base}/.{n}.part") as out:
                    out.write(data)
                fs.move(f"{base}/.{n}.part", f"{base}/{n}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, bytes long")


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path).select("path", timecode.sniff(F.col("content")).alias("format"), "length")
