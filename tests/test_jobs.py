"""Each operation of a job, from files to files that are read back."""

import json

import numpy as np
import pytest

from framelake.__main__ import job, main
from framelake.kernels import codecs, containers
from framelake.plans import jobs

from .test_containers import RNG, sample_packets
from .test_kernels import golden
from .test_models import constants


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    p = golden()
    (tmp_path / "in/a.png").write_bytes(codecs.write_png(p[..., :3]))
    (tmp_path / "in/b.bmp").write_bytes(codecs.write_bmp(p[::-1, :, :3]))
    (tmp_path / "v").mkdir()
    frames = [np.roll(p[..., :3], 5 * k, 1) for k in range(10)]
    (tmp_path / "v/clip.mp4").write_bytes(containers.h264_mp4(frames, 10))
    stream = {"type": "vids", "codec": "av01", "rate": 90000, "width": 64, "height": 48, "config": b""}
    (tmp_path / "v2").mkdir()
    (tmp_path / "v2/x.mp4").write_bytes(containers.write_mp4(stream, sample_packets()))
    (tmp_path / "s").mkdir()
    (tmp_path / "s/t.wav").write_bytes(codecs.write_wav(np.sin(np.arange(800) / 9), 8000))
    pcm = (np.sin(np.arange(400) / 9) * 9000).astype("<i2").tobytes()
    sound = {"type": "auds", "codec": "sowt", "rate": 90000, "channels": 1, "hz": 8000}
    parts = [{"pts": k * 1125, "dts": k * 1125, "duration": 1125, "is_keyframe": True, "data": pcm[k * 200 : k * 200 + 200]} for k in range(4)]
    (tmp_path / "s2").mkdir()
    (tmp_path / "s2/m.m4a").write_bytes(containers.write_mp4(sound, parts))
    return tmp_path


def done(spark, **spec):
    row = jobs.run(spark, json.dumps(spec)).first()
    assert row.success, row.error
    return row.outputs


def test_image_jobs(spark, folder):
    p = golden()[..., :3]
    out = done(spark, operation="filter", inputs=[f"{folder}/in"], output=f"{folder}/o1", transforms=["flip:h", "invert:"])
    assert sorted(o.rpartition("/")[2] for o in out) == ["a.png", "b.png"]
    assert (codecs.read_png((folder / "o1/a.png").read_bytes()) == 255 - p[:, ::-1]).all()
    done(spark, operation="convert", inputs=[f"{folder}/in"], output=f"{folder}/o2", format="bmp")
    assert (codecs.read_bmp((folder / "o2/b.bmp").read_bytes()) == p[::-1]).all()
    done(spark, operation="text", inputs=[f"{folder}/in"], output=f"{folder}/o3", text={"text": "Hi", "x": 2, "y": 2, "size": 8, "color": [255, 0, 0]})
    assert (codecs.read_png((folder / "o3/a.png").read_bytes())[2:9, 2] == (255, 0, 0)).all()
    done(spark, operation="gif", inputs=[f"{folder}/in"], output=f"{folder}/o.gif", fps=5)
    gif = (folder / "o.gif").read_bytes()
    assert gif[:6] == b"GIF89a" and gif.count(b"\x21\xf9\x04") == 2 and (20).to_bytes(2, "little") in gif
    done(spark, operation="encode", inputs=[f"{folder}/in"], output=f"{folder}/o.mp4", fps=25)
    info, packets = containers.read_mp4((folder / "o.mp4").read_bytes())
    assert len(packets) == 2 and info["streams"][0]["rate"] == 25000 and packets[0]["duration"] == 1000
    mask = constants(folder / "m.onnx", np.ones((1, 1, 8, 8)))
    done(spark, operation="remove_bg", inputs=[f"{folder}/in"], output=f"{folder}/o4", model=mask)
    assert codecs.read_png((folder / "o4/a.png").read_bytes()).shape == (48, 64, 4)


def test_packet_jobs(spark, folder):
    clip, other = f"{folder}/v/clip.mp4", f"{folder}/v2/x.mp4"
    data = lambda name: [q["data"] for q in containers.read_mp4((folder / name).read_bytes())[1]]
    done(spark, operation="trim", inputs=[clip], output=f"{folder}/t.mp4", trim={"start": 0.3, "end": 0.7})
    assert data("t.mp4") == data("v/clip.mp4")[3:7] and containers.read_mp4((folder / "t.mp4").read_bytes())[1][0]["dts"] == 0
    done(spark, operation="concat", inputs=[clip, other], output=f"{folder}/c.mp4")
    assert len(data("c.mp4")) == 22 and data("c.mp4")[:10] == data("v/clip.mp4")
    done(spark, operation="transcode", inputs=[clip], output=f"{folder}/f.mp4", speed=2.0)
    fast = containers.read_mp4((folder / "f.mp4").read_bytes())[1]
    assert len(fast) == 5 and [q["dts"] for q in fast] == [9000 * k for k in range(5)]
    done(spark, operation="transcode", inputs=[clip], output=f"{folder}/slow.ivf", speed=0.5)
    assert len(codecs.read_ivf((folder / "slow.ivf").read_bytes())[1]) == 20
    out = done(spark, operation="frames", inputs=[clip], output=f"{folder}/fr", frames={"every": 4, "max_frames": 0, "format": "png"})
    assert sorted(o.rpartition("/")[2] for o in out) == [f"clip_{k:06d}.png" for k in (0, 4, 8)]
    want = containers.from_yuv420(containers.yuv420(np.roll(golden()[..., :3], 20, 1)))
    assert (codecs.read_png((folder / "fr/clip_000004.png").read_bytes()) == want).all()
    done(spark, operation="thumbnail", inputs=[clip], output=f"{folder}/th", position="last")
    assert (folder / "th/clip_000009.png").exists()
    done(spark, operation="info", inputs=[clip], output=f"{folder}/info.json")
    assert json.loads((folder / "info.json").read_text())["frames"] == 10
    bad = jobs.run(spark, json.dumps({"operation": "frames", "inputs": [other], "output": f"{folder}/none"})).first()
    assert not bad.success and "12 rows could not be written" in bad.error
    assert not jobs.run(spark, json.dumps({"operation": "trim", "inputs": [clip], "output": f"{folder}/x.mp4", "trim": {"start": 90}})).first().success


def test_audio_jobs(spark, folder):
    done(spark, operation="audio_encode", inputs=[f"{folder}/s"], output=f"{folder}/a1", format="flac")
    rate, channels, samples = containers.read_flac((folder / "a1/t.flac").read_bytes())
    assert (rate, channels, len(samples)) == (8000, 1, 800)
    done(spark, operation="extract_audio", inputs=[f"{folder}/s2/m.m4a"], output=f"{folder}/a2")
    rate, channels, samples = codecs.read_wav((folder / "a2/m.wav").read_bytes())
    assert rate == 8000 and np.allclose(samples, np.trunc(np.sin(np.arange(400) / 9) * 9000) / 32767, atol=1e-4)


def test_command_line(spark, folder, capsys):
    assert job("video-trim", ["a.mp4", "b.mp4", "--start", "1", "--end", "2"]) == {"operation": "trim", "inputs": ["a.mp4"], "output": "b.mp4", "trim": {"start": 1.0, "end": 2.0}}
    assert job("video-concat", ["a", "b", "c"])["inputs"] == ["a", "b"]
    assert main(["image-filter", f"{folder}/in", f"{folder}/cli", "rotate:0", "flip:v"], spark) == 0
    assert (codecs.read_png((folder / "cli/a.png").read_bytes()) == golden()[::-1, :, :3]).all()
    assert main(["gif", f"{folder}/nowhere", f"{folder}/x.gif"], spark) == 1
    assert main(["capabilities"], spark) == 0 and main(["gpu-info"], spark) == 0 and main(["template", "trim"], spark) == 0
    assert main(["image-info", f"{folder}/in"], spark) == 0 and main(["audio-info", f"{folder}/s"], spark) == 0 and main(["video-info", f"{folder}/v/clip.mp4"], spark) == 0
    assert main(["recenter", f"{folder}/in", f"{folder}/re"], spark) == 0 and len(list((folder / "re").glob("*.png"))) == 2
    assert main([], spark) == 2 and main(["dance", "x"], spark) == 2
    assert RNG is not None and "clip" in capsys.readouterr().out
