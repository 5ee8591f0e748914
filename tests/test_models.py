"""Model operators on graphs written by hand, and what is drawn of their results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.kernels import postprocess as p
from framelake.kernels import text
from framelake.operators import annotate, audio
from framelake.plans import models

from .test_engine import arrays, field, image_rows
from .test_kernels import golden


def value_info(name, rank):
    shape = field(2, b"".join(field(1, field(2, f"{name}{k}".encode())) for k in range(rank)))
    return field(1, name.encode()) + field(2, field(1, field(1, 1) + shape))


def tensor(a):
    a = np.asarray(a, np.float32)
    return b"".join(field(1, d) for d in a.shape) + field(2, 1) + field(9, a.tobytes())


def model_file(path, inputs, outputs, nodes):
    """An ONNX file: inputs by rank, outputs by rank, nodes (op, inputs, output, constant)."""
    body = b""
    for op, ins, out, constant in nodes:
        node = b"".join(field(1, i.encode()) for i in ins) + field(2, out.encode()) + field(4, op.encode())
        if constant is not None:
            node += field(5, field(1, b"value") + field(20, 4) + field(5, tensor(constant)))
        body += field(1, node)
    body += field(2, b"g") + b"".join(field(11, value_info(k, r)) for k, r in inputs.items()) + b"".join(field(12, value_info(k, r)) for k, r in outputs.items())
    path.write_bytes(field(1, 8) + field(7, body) + field(8, field(1, b"") + field(2, 13)))
    return str(path)


def unary(path, op="Identity"):
    return model_file(path, {"x": 4}, {"y": 4}, [(op, ["x"], "y", None)])


def constants(path, *values, inputs=None):
    nodes = [("Constant", [], f"y{k}", v) for k, v in enumerate(values)]
    return model_file(path, inputs or {"x": 4}, {f"y{k}": np.ndim(v) for k, v in enumerate(values)}, nodes)


@pytest.fixture
def picture(spark):
    return image_rows(spark, golden()[..., :3])


def test_images_through_models(spark, tmp_path, picture):
    same = unary(tmp_path / "same.onnx")
    photo = golden()[..., :3]
    bad = spark.createDataFrame([(9, None, None, None)], "image_id long, w int, h int, planes array<array<int>>")
    out = models.restore_faces(picture.unionByName(bad), models.load_restorer(same, side=96)).collect()
    assert out[1].error and out[1].planes is None and (out[0].w, out[0].h) == (64, 48)
    ramp = np.zeros((40, 60, 3), np.uint8) + np.arange(0, 240, 4, dtype=np.uint8)[None, :60, None]
    smooth = image_rows(spark, ramp)
    assert np.abs(arrays(models.restore_faces(smooth, models.load_restorer(same, side=60)))[0].astype(int) - ramp).mean() < 3
    assert (arrays(models.upscale(picture, models.load_upscaler(same, factor=1, tile=64)))[0] == photo).mean() > 0.99
    tiled = arrays(models.upscale_tiled(picture, models.load_upscaler(same, factor=1, tile=16, overlap=4)))[0]
    assert np.abs(tiled.astype(int) - photo).max() <= 1
    assert (arrays(models.upscale_direct(picture, models.load_upscaler(same)))[0].shape) == (48, 64, 3)
    assert (arrays(models.upscale_quick(picture, same, factor=1))[0] == arrays(models.upscale(picture, models.load_upscaler(same, factor=1)))[0]).all()
    assert (arrays(models.stylize(picture, models.load_style_model(same)))[0] == photo).all()
    white = constants(tmp_path / "white.onnx", np.full((1, 3, 48, 64), 255.0))
    half = arrays(models.stylize_blended(picture, models.load_style_model(white), 0.5))[0]
    assert (half == np.floor(photo * 0.5 + 127.5 + 1e-9)).all()
    other = image_rows(spark, np.full((48, 64, 3), 255, np.uint8))
    assert (arrays(models.blended(picture, other, 0.5))[0] == half).all()
    kept = arrays(models.stylize(picture, models.load_style_model(white, preserve_colors=True)))[0]
    assert kept.mean() > photo.mean()
    gray = arrays(models.colorize(smooth, models.load_colorizer(same, side=60)))[0]
    assert (gray[..., 0] == gray[..., 1]).all() and np.abs(gray.astype(int) - ramp).mean() < 3
    ab = constants(tmp_path / "ab.onnx", np.zeros((1, 2, 60, 60)))
    flat = arrays(models.colorize(smooth, models.load_colorizer(ab, side=60)))[0].astype(int)
    assert np.abs(flat[..., 0] - flat[..., 2]).max() <= 2
    with pytest.raises(FileNotFoundError):
        models.load_upscaler(str(tmp_path / "none.onnx"))
    with pytest.raises(ValueError):
        models.load_upscaler(same, speed=3)


def test_lab_round_trip():
    values = np.random.default_rng(1).random((500, 3))
    assert np.allclose(p.from_lab(p.to_lab(values)), values, atol=1e-6)
    assert np.allclose(p.to_lab(np.ones((1, 3)))[0], [100, 0, 0], atol=0.02)


def test_background_masks(spark, tmp_path, picture):
    mask = np.zeros((1, 1, 32, 32))
    mask[..., 16:] = 1
    path = constants(tmp_path / "mask.onnx", mask)
    out = arrays(models.remove_background(picture, models.load_model(path, side=32)))[0]
    assert out.shape == (48, 64, 4) and (out[..., :3] == golden()[..., :3]).all()
    assert out[:, :4, 3].max() < 90 and out[:, -4:, 3].min() > 160
    flat = image_rows(spark, np.full((6, 8, 3), 120, np.uint8))
    masks = spark.createDataFrame([(0, 2, 1, [0.5, 0.5])], "image_id long, mw int, mh int, mask array<double>")
    assert (arrays(models.apply_mask(flat, masks))[0][..., 3] == 128).all()
    guide, m = np.random.default_rng(0).random((9, 7)), np.random.default_rng(1).random((9, 7))

    def mean(a, y, x, r):
        return a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].mean()

    assert all(np.isclose(p.box_mean(guide, 2)[y, x], mean(guide, y, x, 2)) for y in range(9) for x in range(7))
    a = (p.box_mean(guide * m, 2) - p.box_mean(guide, 2) * p.box_mean(m, 2)) / (p.box_mean(guide**2, 2) - p.box_mean(guide, 2) ** 2 + 0.01)
    b = p.box_mean(m, 2) - a * p.box_mean(guide, 2)
    assert np.allclose(p.guided(guide, m, 2), np.clip(p.box_mean(a, 2) * guide + p.box_mean(b, 2), 0, 1))


def test_frames_and_inpainting(spark, tmp_path):
    a, b = np.full((32, 64, 3), 40, np.uint8), np.full((32, 64, 3), 200, np.uint8)
    frames = image_rows(spark, a, b, b[:16]).selectExpr("1L as source", "image_id as frame_no", "w", "h", "planes")
    mix = model_file(tmp_path / "mix.onnx", {"a": 4, "b": 4, "t": 1}, {"y": 4}, [("Sub", ["b", "a"], "d", None), ("Mul", ["d", "t"], "e", None), ("Add", ["a", "e"], "y", None)])
    got = models.interpolate_frames(frames, models.load_interpolator(mix), 3).orderBy("frame_no", "t").collect()
    assert [(r.frame_no, r.t) for r in got] == [(k, t) for k in (0, 1) for t in (0.25, 0.5, 0.75)]
    assert [r.planes[0][0] for r in got[:3]] == [80, 120, 160] and all("same dimensions" in r.error for r in got[3:])
    one = models.interpolate_frame(frames, models.load_interpolator(mix), 0.1).orderBy("frame_no").first()
    assert abs(one.planes[0][0] - 56) <= 1
    keep = model_file(tmp_path / "fill.onnx", {"x": 4, "m": 4}, {"y": 4}, [("Constant", [], "one", [1.0]), ("Sub", ["one", "m"], "k", None), ("Mul", ["x", "k"], "y", None)])
    hole = np.zeros((32, 64, 1), np.uint8)
    hole[8:16, 16:32] = 255
    mask = image_rows(spark, hole)
    out = arrays(models.inpaint(image_rows(spark, b), mask, models.load_inpainter(keep, side=64, dilate=0)))[0]
    assert out[11:13, 20:28].max() < 30 and (out[24:, 48:] == 200).all()
    grown = arrays(models.inpaint(image_rows(spark, b), mask, models.load_inpainter(keep, side=64, dilate=6)))[0]
    assert (grown < 100).sum() > (out < 100).sum()


def test_detections_poses_and_faces(spark, tmp_path, picture):
    boxes = np.array([[0, 0, 32, 32], [1, 0, 33, 32], [40, 40, 60, 60], [5, 5, 6, 6]])
    path = constants(tmp_path / "faces.onnx", boxes[None], np.array([[0.9, 0.8, 0.7, 0.1]]), np.tile(np.arange(10.0), (1, 4, 1)))
    found = models.detect_faces(picture, models.load_detector(path, side=64)).orderBy("det_id").collect()
    assert [(r.x, r.y, r.w, r.h, round(r.score, 3)) for r in found] == [(0, 0, 32, 24, 0.9), (40, 30, 20, 15, 0.7)]
    assert found[0].landmarks[1] == [2.0, 2.25]
    table = constants(tmp_path / "table.onnx", np.concatenate([boxes, [[0.9], [0.8], [0.7], [0.1]]], 1))
    assert [r.score for r in models.detect_faces_quick(picture, table).collect()] == [r.score for r in found]
    rng = np.random.default_rng(2)
    corners = rng.random((60, 2)) * 50
    many, scores = np.concatenate([corners, corners + rng.random((60, 2)) * 30 + 1], 1), rng.random(60)
    keep = []
    for k in np.argsort(-scores):
        inter = [max(0, min(many[k][2], many[j][2]) - max(many[k][0], many[j][0])) * max(0, min(many[k][3], many[j][3]) - max(many[k][1], many[j][1])) for j in keep]
        area = lambda q: (many[q][2] - many[q][0]) * (many[q][3] - many[q][1])
        if all(i / (area(k) + area(j) - i) < 0.4 for i, j in zip(inter, keep)):
            keep.append(int(k))
    assert p.suppressed(many, scores, 0.4) == keep
    points = np.zeros((1, 1, 17, 3)) + [0.25, 1.5, 0.8]
    pose = models.detect_pose(picture, models.load_pose_model(constants(tmp_path / "pose.onnx", points))).first()
    assert pose.points[0] == pytest.approx([1.0, 0.25, 0.8]) and pose.confidence == pytest.approx(0.8)
    crowd = np.zeros((1, 3, 56))
    crowd[0, :2, 2:51:3] = 0.5
    assert models.detect_pose(picture, models.load_pose_model(constants(tmp_path / "crowd.onnx", crowd))).count() == 2
    age, gender, mood = (constants(tmp_path / f"{n}.onnx", np.array([v])) for n, v in (("age", [33.0]), ("gender", [0.0, 3.0]), ("mood", [0.0, 2, 2, 0, 0, 0, 0])))
    analyzer = models.load_analyzer(age, gender=gender, emotion=mood, smallest=16)
    r = models.analyze_face(picture, analyzer).first()
    assert (r.age, r.gender, r.emotion) == (33.0, "male", "sad") and abs(sum(r.emotions) - 1) < 1e-6
    faces = spark.createDataFrame([(0, 0, 2, 2, 20, 20), (0, 1, 5, 5, 8, 8)], "image_id long, det_id int, x int, y int, w int, h int")
    assert [r.det_id for r in models.analyze_faces(picture, faces, analyzer).collect()] == [0]
    marked = arrays(models.analyze_and_annotate(picture, faces, analyzer))[0]
    assert (marked[2, 2:22] == (0, 255, 0)).all()
    boxed = arrays(annotate.detections(picture, models.detect_faces(picture, models.load_detector(path, side=64))))[0]
    assert (boxed[0, 5:30] == (0, 255, 0)).all()
    assert (arrays(annotate.detections(picture, faces.limit(0)))[0] == golden()[..., :3]).all()
    line = np.tile(np.array([0.5, 0.5, 0.9]), (17, 1))
    line[:, 0] = np.linspace(0.1, 0.9, 17)
    people = spark.createDataFrame([(0, 0, line.tolist())], "image_id long, person int, points array<array<double>>")
    assert (arrays(annotate.poses(picture, people))[0] != golden()[..., :3]).any()


def test_depth(spark, tmp_path, picture):
    depth = np.tile(np.arange(8.0), (8, 1))[None, None]
    path = constants(tmp_path / "depth.onnx", depth)
    out = models.estimate_depth(picture, models.load_depth_estimator(path, side=8))
    d = np.array(out.first().depth).reshape(48, 64)
    assert d.min() == 0 and d.max() == 1 and (np.diff(d, axis=1) >= 0).all()
    inverse = np.array(models.estimate_depth(picture, models.load_depth_estimator(path, side=8, invert=True)).first().depth).reshape(48, 64)
    assert np.allclose(inverse, 1 - d)
    assert [models.depth_at(out, *at).first().depth for at in ((0, 0), (63, 47), (64, 0), (0, -1))] == [0.0, 1.0, None, None]


def test_text_of_images(spark, tmp_path):
    quads = np.array([[[30, 4, 50, 4, 50, 14, 30, 14, 0.9], [4, 6, 24, 6, 24, 16, 4, 16, 0.8], [4, 30, 24, 30, 24, 40, 4, 40, 0.7], [0, 0, 1, 0, 1, 1, 0, 1, 0.2]]])
    detector = constants(tmp_path / "detect.onnx", quads.astype(float))
    steps = np.zeros((1, 6, 4))
    for t, k in enumerate((1, 1, 0, 1, 3, 3)):
        steps[0, t, k] = 0.9
    reader = constants(tmp_path / "read.onnx", steps)
    df = image_rows(spark, np.full((48, 64, 3), 250, np.uint8))
    got = models.extract_text(df, models.load_ocr_model(detector, recognizer=reader, alphabet="abc")).first()
    assert got.text == "aac\naac\naac" and [b.x for b in got.blocks] == [4, 30, 4] and got.confidence == pytest.approx(0.9)
    assert models.extract_text_simple(df, models.load_ocr_model(detector, recognizer=reader, alphabet="abc")).first().text == got.text
    found = spark.createDataFrame([got.asDict(True)], models.TEXT)
    assert (arrays(annotate.recognised(df, found))[0][4, 30:51] == (0, 255, 0)).all()
    tilted = np.array([[27.0, 18], [10, 2], [7, 12], [30, 8]])
    assert p.rectified(golden()[..., :3], tilted).shape == (10, 21, 3) and p.ordered_quad(tilted).tolist() == [[10, 2], [30, 8], [27, 18], [7, 12]]
    square = np.array([[8.0, 6], [31, 6], [31, 25], [8, 25]])
    assert p.rectified(golden()[..., :3], square).shape[:2] == (19, 23)


def test_clips_through_models(spark, tmp_path):
    tokens = constants(tmp_path / "asr.onnx", np.array([[50364.0, 5, 6, 50414, 50414, 7, 50257, 9]]), inputs={"x": 3})
    clips = spark.createDataFrame([(1, 8000, [0.1] * 4000)], "clip_id long, sample_rate int, samples array<double>")
    got = models.transcribe(clips, models.load_transcriber(tokens)).orderBy("start").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(0.0, 1.0, "[5][6]"), (1.0, None, "[7]")]
    halves = model_file(tmp_path / "stems.onnx", {"x": 2}, {"y": 2}, [("Constant", [], "k", [[0.25], [0.75]]), ("Mul", ["x", "k"], "y", None)])
    model = models.load_separator(halves, chunk=1000, stems=("vocals", "other"))
    stems = {r.stem: r.samples for r in models.separate(clips, model).collect()}
    assert np.allclose(stems["vocals"], 0.025) and np.allclose(stems["other"], 0.075) and len(stems["other"]) == 4000
    assert np.allclose(models.remove_vocals(clips, model).first().samples, 0.075)
    assert np.allclose(models.isolate_vocals(clips, model).first().samples, 0.025)


def test_glyphs_and_plots(spark, picture):
    assert set(text.GLYPHS) == {chr(k) for k in range(32, 127)} and all(len(g) == 10 for g in text.GLYPHS.values())
    assert text.dots("I").sum() == 11 and text.dots("é").sum() == 20 and text.dots("a\nbc").shape == (16, 12)
    assert text.wrapped("one two threefour", 5) == "one\ntwo\nthree\nfour"
    out = arrays(annotate.draw_text(picture, "Hi", x=3, y=4, size=16, color=(255, 0, 0)))[0]
    mask = np.kron(text.dots("Hi"), np.ones((2, 2), bool)).astype(bool)
    assert (out[4:20, 3:27][mask] == (255, 0, 0)).all() and (out[4:20, 3:27][~mask] == golden()[4:20, 3:27, :3][~mask]).all()
    low = arrays(annotate.draw_text(picture, "x", anchor="bottom-right"))[0]
    assert (low[:40] == golden()[:40, :, :3]).all() and (low != golden()[..., :3]).any()
    own = picture.withColumn("text", F.lit(None).cast("string"))
    assert (arrays(annotate.draw_text(own))[0] == golden()[..., :3]).all()
    with pytest.raises(ValueError):
        annotate.draw_text(picture, "x", anchor="left")
    texts = spark.createDataFrame([(0, "a", 1, 1), (0, "b", 20, 20), (0, None, 1, 1), (5, "c", 1, 1)], "image_id long, text string, x int, y int")
    assert (arrays(annotate.draw_texts(picture, texts))[0][20:27, 20:25] != golden()[20:27, 20:25, :3]).any()
    frames = picture.withColumn("t", F.lit(12.0))
    cues = spark.createDataFrame([(11.0, 13.0, "sub"), (0.0, 12.0, "gone")], "start double, end double, text string")
    burnt = arrays(annotate.subtitles(frames, cues, size=8))[0]
    assert (burnt[-16:-9] == 255).all(2).sum() >= text.dots("sub").sum() and (burnt[:20] == golden()[:20, :, :3]).all()
    assert (arrays(annotate.subtitles(frames, cues.limit(0)))[0] == golden()[..., :3]).all()
    long = spark.range(400).selectExpr("1L as clip_id", "id as i", "sin(id / 10D) as s")
    wave = arrays(annotate.waveforms(audio.waveform_points(long, 40), 32))[0]
    assert wave.shape == (32, 40, 3)
    clips = spark.createDataFrame([(1, np.sin(np.arange(400) / 3).tolist())], "clip_id long, samples array<double>")
    assert arrays(annotate.spectra(audio.spectra(clips), 20, 50))[0].shape == (20, 50, 3)
    assert arrays(annotate.spectrograms(audio.spectrograms(clips, 8, 6), 8, 6))[0].shape == (6, 8, 1)
    assert annotate.vectorized(picture).first().svg.startswith("<svg")
