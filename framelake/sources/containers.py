"""Packets of IVF, AVI, MP4 and Matroska files as a Python data source: spark.read.format("media_packets").load(path).

Each file is a partition. pts, dts and duration are in 1/90000 s, i counts the packets of a stream in order of dts, and
codec, width, height, hz, channels and config are the stream's, so that packets can be written to a file again.
"""

from __future__ import annotations

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..kernels import codecs, containers

SCALE = 90_000
READERS = {"ivf": codecs.read_ivf, "avi": codecs.read_avi, **dict.fromkeys(("mp4", "m4v", "m4a", "mov"), containers.read_mp4), **dict.fromkeys(("mkv", "webm", "mka"), containers.read_mkv)}
SCHEMA = "source string, stream_index int, kind string, codec string, width int, height int, hz int, channels int, config binary, i bigint, pts bigint, dts bigint, duration bigint, is_keyframe boolean, size bigint, data binary"


def packets(name: str, data: bytes) -> list[tuple]:
    """The rows of one file."""
    info, found = READERS[name.rpartition(".")[2].lower()](data)
    streams = info.get("streams") or [{"type": "vids", "codec": info["codec"], "rate": info["rate"], "scale": info["scale"]}]
    out, count = [], {}
    for p in sorted(found, key=lambda p: p["dts"] * streams[p["stream_index"]].get("scale", 1) / max(1, streams[p["stream_index"]].get("rate", 1))):
        k = p["stream_index"]
        s = streams[k] if k < len(streams) else {}
        clock = lambda t: t * SCALE * s.get("scale", 1) // max(1, s.get("rate", 1))  # noqa: B023, E731
        i = count[k] = count.get(k, -1) + 1
        size = (s.get("width", info.get("width")), s.get("height", info.get("height"))) if s.get("type") == "vids" else (None, None)
        out.append((name, k, s.get("type"), s.get("codec"), *size, s.get("hz"), s.get("channels"), s.get("config") or None, i, clock(p["pts"]), clock(p["dts"]), clock(p["dts"] + p["duration"]) - clock(p["dts"]), p["is_keyframe"], len(p["data"]), p["data"]))
    return out


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = fs.get_file_info(base)
        found = fs.get_file_info(pyarrow.fs.FileSelector(base)) if info.type == pyarrow.fs.FileType.Directory else [info]
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.extension.lower() in READERS]

    def read(self, partition):
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with fs.open_input_stream(partition.path) as f:
            data = f.read()
        yield from packets(partition.path, data)


class MediaPackets(DataSource):
    @classmethod
    def name(cls):
        return "media_packets"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaPackets)


def decode(kind: str, codec: str, config: bytes | None, width: int, height: int, data: bytes):
    """The picture of a packet, where it needs no codec: AVI's plain bitmaps and H.264 of plain samples."""
    import numpy as np

    if codec in ("", "DIB", "RGB") and width and height and len(data) >= height * (-(-width * 3 // 4) * 4):
        line = -(-width * 3 // 4) * 4
        rows = np.frombuffer(data, np.uint8, height * line).reshape(height, line)[::-1, : width * 3]
        return np.ascontiguousarray(rows.reshape(height, width, 3)[..., ::-1])
    if codec in ("avc1", "H264", "h264"):
        unit = containers.mp4_annex_b({"config": config}, {"data": data}) if config else data
        return containers.read_plain_h264(unit, width, height)
    raise ValueError(f"no decoder for {codec or kind}")


def frames(rows: DataFrame) -> DataFrame:
    """Pictures of packets: source, i, pts, and an image in compact form (w, h, channels, data) or its error."""
    import pyarrow as pa

    from .files import IMAGE_FIELDS

    kinds = pa.schema([("source", pa.string()), ("i", pa.int64()), ("pts", pa.int64()), *IMAGE_FIELDS])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = {"source": row["source"], "i": row["i"], "pts": row["pts"], "error": None}
                try:
                    image = decode(row["kind"], row["codec"], row["config"], row["width"], row["height"], row["data"])
                    out |= {"w": image.shape[1], "h": image.shape[0], "channels": 3, "data": image.tobytes()}
                except Exception as error:  # noqa: BLE001  a bad packet is a result
                    out["error"] = f"{type(error).__name__}: {error}"[:300]
                yield pa.RecordBatch.from_pylist([out], kinds)

    return rows.where("kind = 'vids'").mapInArrow(run, "source string, i long, pts long, w int, h int, channels int, data binary, error string")


def write_container(rows: DataFrame, path: str) -> DataFrame:
    """One file of the packets of one stream, by the path's ending (mp4, ivf); its packets go through one task, as it is one file.

    Gives path, packets and bytes.
    """
    import pyarrow as pa

    kind = path.rpartition(".")[2].lower()
    if kind not in ("mp4", "m4v", "ivf"):
        raise ValueError(f"can't write {kind} files")

    def run(batches):
        found = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda r: (r["dts"], r["i"]))
        if not found:
            return
        head = found[0]
        parts = [{"pts": r["pts"], "dts": r["dts"], "duration": r["duration"], "is_keyframe": r["is_keyframe"], "data": r["data"]} for r in found]
        if kind == "ivf":
            data = codecs.write_ivf([(p["pts"], p["data"]) for p in parts], head["width"] or 0, head["height"] or 0, SCALE, 1, (head["codec"] or "AV01").encode()[:4].ljust(4))
        else:
            stream = {"type": head["kind"], "codec": (head["codec"] or "raw ")[:4].ljust(4), "rate": SCALE, "width": head["width"] or 0, "height": head["height"] or 0, "hz": head["hz"] or 0, "channels": head["channels"] or 0, "config": head["config"] or b""}
            data = containers.write_mp4(stream, parts)
        write_whole(path, data)
        yield pa.RecordBatch.from_pylist([{"path": path, "packets": len(parts), "bytes": len(data)}])

    return rows.repartition(1).mapInArrow(run, "path string, packets long, bytes long")


def write_whole(path: str, data: bytes) -> None:
    """A file under another name first, so that it is there whole or not at all."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    folder = name.rpartition("/")[0]
    if folder:
        fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(name + ".part") as out:
        out.write(data)
    fs.move(name + ".part", name)
