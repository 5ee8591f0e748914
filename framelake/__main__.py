"""python -m framelake COMMAND ...

exec JOB.json | template OPERATION | capabilities | gpu-info
image-info PATH | image-filter IN OUT STEP... | convert IN OUT --format F | text-overlay IN OUT TEXT | remove-bg IN OUT --model M
recenter IN OUT | gif IN OUT.gif --fps N | encode-sequence IN OUT.mp4 --fps N
video-info IN | video-frames IN OUT --every N | video-thumbnail IN OUT | video-trim IN OUT --start S --end S
video-concat IN IN... OUT | video-transcode IN OUT --speed X | extract-audio IN OUT --format F | audio-info IN | audio-encode IN OUT --format F

All commands but the last-mentioned infos write files by plans.jobs and end with 1 where a job fails.
"""

from __future__ import annotations

import argparse
import json
import sys

#: Commands that are jobs, with their operations.
JOBS = {
    "image-filter": "filter", "convert": "convert", "text-overlay": "text", "remove-bg": "remove_bg", "gif": "gif", "encode-sequence": "encode",
    "h264-encode": "encode", "video-encode": "encode", "video-frames": "frames", "video-thumbnail": "thumbnail", "video-trim": "trim", "video-concat": "concat",
    "video-transcode": "transcode", "extract-audio": "extract_audio", "audio-encode": "audio_encode", "video-info": "info",
}


def job(command: str, args: list[str]) -> dict:
    """The job of a command line."""
    parser = argparse.ArgumentParser(prog=f"framelake {command}")
    parser.add_argument("paths", nargs="+")
    for name in ("format", "model", "position"):
        parser.add_argument(f"--{name}")
    for name, kind in (("fps", float), ("speed", float), ("start", float), ("end", float), ("every", int), ("max-frames", int), ("size", int), ("x", int), ("y", int)):
        parser.add_argument(f"--{name}", type=kind)
    parser.add_argument("--anchor")
    o = parser.parse_args(args)
    operation, paths = JOBS[command], o.paths
    spec: dict = {"operation": operation, **{k: getattr(o, k) for k in ("format", "model", "position", "fps", "speed") if getattr(o, k) is not None}}
    if operation == "info":
        return spec | {"inputs": paths}
    if operation == "concat":
        return spec | {"inputs": paths[:-1], "output": paths[-1]}
    if len(paths) < 2:
        parser.error("an input and an output are needed")
    spec |= {"inputs": paths[:1], "output": paths[1]}
    if operation == "filter":
        spec["transforms"] = paths[2:]
    if operation == "text":
        spec["text"] = {"text": " ".join(paths[2:]), **{k: getattr(o, k) for k in ("size", "x", "y", "anchor") if getattr(o, k) is not None}}
    if operation == "trim" or o.start is not None or o.end is not None:
        spec["trim"] = {"start": o.start or 0.0, "end": o.end or 0.0}
    if operation == "frames":
        spec["frames"] = {"every": o.every or 1, "max_frames": o.max_frames or 0, "format": o.format or "png"}
    return spec


def main(args: list[str], spark=None) -> int:
    from .plans.jobs import JobSpec

    command, rest = (args[0], args[1:]) if args else ("", [])
    if command == "template" and len(rest) == 1:
        print(JobSpec.template(rest[0]))
        return 0
    known = {"exec", "capabilities", "gpu-info", "image-info", "audio-info", "recenter", *JOBS}
    if command not in known or command not in ("capabilities", "gpu-info") and not rest:
        print(__doc__)
        return 2
    if command == "gpu-info":
        import onnxruntime

        print(json.dumps({"providers": onnxruntime.get_available_providers()}))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    from . import sources
    from .plans import capabilities, jobs

    if command == "capabilities":
        capabilities.report(spark).show(100, False)
    elif command == "image-info":
        sources.read_images(spark, rest[0]).drop("data").show(100, False)
    elif command == "audio-info":
        rows = sources.read_audio(spark, rest[0])
        rows.selectExpr("path", "sample_rate", "channels", "size(samples) div channels / sample_rate as seconds", "error").show(100, False)
    elif command == "recenter":
        from pyspark.sql import functions as F

        from .operators import geometry
        from .sources import files

        images = geometry.recenter(sources.images(sources.read_images(spark, rest[0])))
        files.write_files(files.encode_images(images, "png").withColumn("name", F.concat(F.hex("image_id"), F.lit(".png"))), f"file://{rest[1]}").show(100, False)
    else:
        source = json.dumps(job(command, rest)) if command in JOBS else sys.stdin.read() if rest[0] == "-" else rest[0]
        if command == "video-info":
            jobs.plan(spark, JobSpec.parse(source)).show(100, False)
            return 0
        row = jobs.run(spark, source).first()
        print(row.asDict())
        return 0 if row.success else 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
