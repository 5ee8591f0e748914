import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import model, sources
from framelake.functions import color, timecode
from framelake.kernels import codecs
from framelake.operators import detection, geometry, neighbourhood, pixels, subtitles
from framelake.plans import infer, jobs
from framelake.queries import QUERIES
from framelake.sources import files

from .test_kernels import avi, golden


def image_rows(spark, *pictures):
    rows = [(k, p.shape[1], p.shape[0], [p[..., c].astype(int).ravel().tolist() for c in range(p.shape[2])]) for k, p in enumerate(pictures)]
    return spark.createDataFrame(rows, "image_id long, w int, h int, planes array<array<int>>")


def arrays(df):
    return [np.array(r.planes, np.uint8).T.reshape(r.h, r.w, -1) for r in df.orderBy("image_id").collect()]


def test_geometry_golden(spark):
    p = golden()
    df = image_rows(spark, p)
    want = {geometry.flip_horizontal: p[:, ::-1], geometry.flip_vertical: p[::-1], geometry.rotate_90: np.rot90(p, -1), geometry.rotate_180: p[::-1, ::-1], geometry.rotate_270: np.rot90(p), geometry.transpose: p.transpose(1, 0, 2)}
    for f, expected in want.items():
        assert (arrays(f(df))[0] == expected).all(), f.__name__
    assert (arrays(geometry.crop(df, 8, 6, 24, 20))[0] == p[6:26, 8:32]).all()
    assert (arrays(geometry.rotate_90(geometry.rotate_270(df)))[0] == p).all()
    assert (arrays(geometry.pad(df, 1, 2, 3, 4, (9, 8, 7, 6)))[0][0, 0] == (9, 8, 7, 6)).all()
    out = arrays(geometry.rotate_bounded(df, 33))[0]
    assert out.shape[0] > 48 and out.shape[1] > 64 and (out[0, 0] == 0).all()
    with pytest.raises(Exception, match="out of bounds"):
        geometry.crop(df, 60, 0, 24, 20).collect()
    square = [(0, 0), (63, 0), (63, 47), (0, 47)]
    assert (arrays(geometry.perspective_transform(df, square, square, 64, 48))[0] == p).all()
    assert np.allclose(np.array(geometry.solve_homography([(1, 1), (3, 1), (3, 3), (1, 3)], [(0, 0), (2, 0), (2, 2), (0, 2)])), [[1, 0, 1], [0, 1, 1], [0, 0, 1]])


def test_color_literals(spark):
    px = spark.createDataFrame([(0, 0, 0, 1, 1, 128, 64, 32, 200)], "image_id long, x int, y int, w int, h int, r int, g int, b int, a int")
    one = lambda f, *args: tuple(pixels.adjust(px, f, *args).select("r", "g", "b", "a").first())
    assert one(color.invert) == (127, 191, 223, 200)
    assert one(color.brightness, 100) == (255, 255, 255, 200)
    assert one(color.exposure, 1)[0] > 128 and one(color.gamma, 0.5)[0] > 128
    assert len(set(one(color.saturation, -100)[:3])) == 1 and one(color.grayscale)[3] == 200
    for bad in ((color.brightness, float("nan")), (color.gamma, 0)):
        with pytest.raises(ValueError):
            one(*bad)
    with pytest.raises(ValueError):
        pixels.filter_chain(px, {"sparkle": 1})


def test_filters(spark):
    flat = np.full((6, 5, 3), 90, np.uint8)
    df = image_rows(spark, flat)
    assert (arrays(neighbourhood.gaussian_blur(df, 1.5))[0] == 90).all()
    assert (arrays(neighbourhood.edge_detect(df, 1))[0] == 0).all()
    assert (arrays(neighbourhood.gaussian_blur(df, 0))[0] == 90).all()
    with pytest.raises(ValueError):
        neighbourhood.gaussian_blur(df, -1)


def test_image_files(spark, tmp_path):
    p = golden()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/frame_0001.png").write_bytes(codecs.write_png(p))
    (tmp_path / "in/frame_0003.bmp").write_bytes(codecs.write_bmp(p[..., :3]))
    (tmp_path / "in/bad.png").write_bytes(b"junk")
    rows = {r.path.rpartition("/")[2]: r for r in sources.read_images(spark, f"{tmp_path}/in").collect()}
    assert rows["bad.png"].error and rows["frame_0001.png"].channels == 4 and rows["frame_0001.png"].data == p.tobytes()
    assert sources.images(sources.read_images(spark, f"{tmp_path}/in")).count() == 2
    assert [r.frame_no for r in files.numbered(spark, f"{tmp_path}/in/frame_%d.png").collect()] == [1]
    assert {r.path.rpartition(".")[2]: r.format for r in files.sniffed(spark, f"{tmp_path}/in").where("format is not null").collect()} == {"png": "png", "bmp": "bmp"}
    out = files.encode_images(image_rows(spark, p), "png").withColumn("name", F.lit("x.png"))
    assert files.write_files(out, f"file://{tmp_path}/out").collect()[0].bytes == os.path.getsize(tmp_path / "out/x.png")
    assert (codecs.read_png((tmp_path / "out/x.png").read_bytes()) == p).all()


def test_audio_and_packets(spark, tmp_path):
    s = np.sin(np.arange(100) * 0.2)
    (tmp_path / "a.wav").write_bytes(codecs.write_wav(s, 8000))
    row = sources.read_audio(spark, str(tmp_path)).first()
    assert row.sample_rate == 8000 and np.allclose(row.samples, s, atol=1e-4)
    (tmp_path / "v").mkdir()
    (tmp_path / "v/x.avi").write_bytes(avi())
    (tmp_path / "v/y.ivf").write_bytes(codecs.write_ivf([(0, bytes([0x32, 1, 0])), (1, bytes([0x32, 1, 0x20]))], 64, 48, 30, 1))
    sources.register(spark)
    got = spark.read.format("media_packets").load(f"{tmp_path}/v")
    assert got.count() == 6 and got.where("is_keyframe and stream_index = 0").count() == 2


def test_subtitle_parsers(spark):
    one = lambda f, text: [tuple(r) for r in f(spark.createDataFrame([("t", text)], "track_id string, content string")).select("idx", "start", "end", "text").collect()]
    srt = "﻿1\n00:00:01,000 --> 00:00:05,000\nHello <b>bold</b>\n\n2\n00:00:06,500 --> 00:00:10,000\nTwo\nlines\n\nx\nbroken\nblock\n"
    assert one(subtitles.parse_srt, srt) == [(1, 1.0, 5.0, "Hello bold"), (2, 6.5, 10.0, "Two\nlines")]
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:05.000 align:middle\nHi\n\n00:00:06.000 --> 00:00:07.000\n<v Bob>yo"
    assert one(subtitles.parse_vtt, vtt) == [(1, 1.0, 5.0, "Hi"), (2, 6.0, 7.0, "yo")]
    ass = "[Script Info]\nTitle: T\n\n[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:01.50,0:00:02.00,Default,{\\b1}Hello\\Nthere, you{\\b0}\nDialogue: 0,x,y,Default,z"
    assert one(subtitles.parse_ass, ass) == [(1, 1.5, 2.0, "Hello\nthere, you"), (2, 0.0, 0.0, "z")]
    with pytest.raises(Exception, match="invalid SRT start time"):
        one(subtitles.parse_srt, "1\n00:xx:01,000 --> 00:00:05,000\nHello\n")
    times = spark.createDataFrame([(0.0,), (1.5,), (3661.123,)], "s double").select(timecode.srt_time(F.col("s")), timecode.ass_time(F.col("s"))).collect()
    assert [t[0] for t in times] == ["00:00:00,000", "00:00:01,500", "01:01:01,123"] and times[1][1] == "0:00:01.50"


def test_format_size_of_large_keys(spark, tmp_path):
    def size(n):
        return next((f"{float(n) / 1024**e:.2f} {u}" for e, u in ((3, "GB"), (2, "MB"), (1, "KB")) if n >= 1024**e), f"{n} bytes")

    def text(k, c):
        return size(abs(k * k * (c + 1)) // 3 * (1 if c >= 0 else -1))  # cut, as // of DuckDB and div of Spark

    # Each remainder by 3 and sign, halves of a hundredth, two whose shortest decimal form ends in a 5 that the value does not, and products below and above the largest bigint.
    keys = [(k, c) for k in range(-4, 5) for c in range(-5, 5)] + [(24, 5), (72, 1), (1773, 0), (1774, 0), (1412440, 137810), (1850440, 192467), (4499999, 449999), (8999999, 899999), (-8999998, 899998), (200000000, 200000000)]
    spark.createDataFrame([*keys, (None, 1), (1, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in QUERIES["format_size"](spark, str(tmp_path)).select("o_orderkey", "text").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(k, text(k, c)) for k, c in keys] + [(None, None), (1, None)]))
    sizes = [0, 1023, 1024, 1152, 1408, 2**20 - 1, 2**20, 2**30 - 1, 2**30, 2**53 + 1, 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", timecode.format_size(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == {n: size(n) for n in sizes}


def test_detection_literals(spark):
    b = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"))))
    r = spark.range(1).select(detection.iou(b(0, 0, 10, 10), b(20, 20, 30, 30)), detection.iou(b(0, 0, 10, 10), b(0, 0, 10, 10)), detection.iou(b(0, 0, 10, 10), b(5, 5, 15, 15))).first()
    assert r[0] == 0 and r[1] == 1 and abs(r[2] - 25 / 175) < 1e-12
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    assert abs(spark.range(1).select(detection.joint_angle(p(0, 0), p(0, 1), p(1, 1))).first()[0] - 90) < 1e-9
    tokens = spark.createDataFrame([(1, k, t) for k, t in enumerate([50364, 5, 6, 50414, 7, 50464, 50257, 9])], "clip_id long, pos int, token int")
    got = sorted(tuple(r) for r in detection.token_segments(tokens).collect())
    assert [(g[3], round(g[1], 2)) for g in got] == [("[5][6]", 0.0), ("[7]", 1.0)]


def test_jobs(spark):
    p = golden()
    inputs = {"a": image_rows(spark, p[..., :3])}
    spec = jobs.JobSpec.parse(json.dumps({"operation": "filter", "inputs": ["a"], "transforms": ["flip:h", "invert:", "brightness:0"]}))
    assert (arrays(jobs.plan(spark, spec, inputs))[0] == 255 - p[:, ::-1, :3]).all()
    pk = model.packets(spark, "/root/testdata/sf0.001")
    trimmed = jobs.JobSpec.parse('{"operation": "trim", "inputs": ["p"], "trim": {"start": 0.2, "end": 0.9}}')
    assert jobs.plan(spark, trimmed, {"p": pk}).count() > 0
    assert jobs.run(spark, '{"operation": "filter", "inputs": ["a"]}', inputs).first().error == "ValueError: the output is missing"
    for bad in ('{"operation": "dance"}', '{"operation": "concat", "inputs": ["p"]}', '{"operation": "filter", "inputs": ["a"], "transforms": ["sparkle:1"]}', "{bad json"):
        assert not jobs.run(spark, bad, inputs).first().success
    assert jobs.JobSpec.parse(jobs.JobSpec.template("frames")).frames.every == 1


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def identity_model():
    """An ONNX graph y = Neg(x) of floats [1, 3, n, n], written by hand."""
    shape = field(2, field(1, field(1, 1)) + field(1, field(1, 3)) + field(1, field(2, b"h")) + field(1, field(2, b"w")))
    info = lambda name: field(1, name) + field(2, field(1, field(1, 1) + shape))
    graph = field(1, field(1, b"x") + field(2, b"y") + field(4, b"Neg")) + field(2, b"g") + field(11, info(b"x")) + field(12, info(b"y"))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_inference(spark, tmp_path):
    path = tmp_path / "m.onnx"
    path.write_bytes(identity_model())
    df = image_rows(spark, golden()[..., :3], golden()[:5, :5, :1])
    prepare = lambda row: [infer.to_tensor(np.array(row["planes"], np.uint8).T.reshape(row["h"], row["w"], -1), imagenet=False)]
    finish = lambda row, out: {"image_id": row["image_id"], "mean": float(out[0].mean())}
    got = infer.infer(df, str(path), prepare, finish, "image_id long, mean double, error string").collect()
    assert abs(got[0].mean + golden()[..., :3].mean() / 255) < 1e-6 and got[0].error is None and got[1].error


def test_streaming(spark, tmp_path):
    from framelake import streaming

    rows = [(1, i, 0.01 if 3 <= i < 9 else 0.5) for i in range(12)]
    spark.createDataFrame(rows, "clip_id long, i long, s double").coalesce(1).write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema("clip_id long, i long, s double").parquet(f"{tmp_path}/s")
    q = streaming.silence_stream(stream, 0.1, 3).writeStream.format("memory").queryName("silence").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("silence").collect()] == [(1, 3, 9)]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.png").write_bytes(codecs.write_png(golden()))
    q = streaming.image_stream(spark, f"{tmp_path}/img").writeStream.format("memory").queryName("img").option("checkpointLocation", f"{tmp_path}/d").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("img").first().format == "png"
