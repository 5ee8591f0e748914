import hashlib
import struct

import numpy as np
import pytest

from framelake import sources
from framelake.kernels import codecs, containers
from framelake.operators import timeline
from framelake.sources import files

from .test_engine import image_rows
from .test_kernels import avi, golden

RNG = np.random.default_rng(8)


def sample_packets(n=12, step=3000):
    order = [k + (1 if k % 3 == 1 else -1 if k % 3 == 2 else 0) for k in range(n)]  # pictures out of order
    return [{"pts": order[k] * step, "dts": k * step, "duration": step, "is_keyframe": k % 6 == 0, "stream_index": 0, "data": RNG.bytes(50 + k)} for k in range(n)]


def test_mp4_round_trip():
    stream = {"type": "vids", "codec": "av01", "rate": 90000, "scale": 1, "width": 64, "height": 48, "config": b"\x81\0\0\0"}
    packets = sample_packets()
    info, back = containers.read_mp4(containers.write_mp4(stream, packets))
    assert back == packets and info["streams"] == [stream]
    sound = {"type": "auds", "codec": "sowt", "rate": 8000, "scale": 1, "channels": 2, "hz": 8000}
    parts = [p | {"pts": p["dts"], "is_keyframe": True} for p in packets]
    info, back = containers.read_mp4(containers.write_mp4(sound, parts))
    assert back == parts and info["streams"][0] == sound
    for bad in (b"", b"junk" * 9, containers.write_mp4(stream, packets)[:60]):
        with pytest.raises((ValueError, struct.error)):
            containers.read_mp4(bad)


def vsize(n, width=4):
    return (n | 1 << 7 * width).to_bytes(width, "big")


def el(name, *parts):
    body = b"".join(parts)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vsize(len(body)) + body


def test_matroska_by_hand():
    num = lambda n: n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")
    track = el(containers.TRACK, el(containers.NUMBER, num(1)), el(containers.KIND, num(1)), el(containers.CODEC, b"V_AV1"), el(containers.DEFAULT, num(40_000_000)), el(containers.VIDEO, el(containers.WIDTH, num(320)), el(containers.HEIGHT, num(240))))
    audio = el(containers.TRACK, el(containers.NUMBER, num(2)), el(containers.KIND, num(2)), el(containers.CODEC, b"A_PCM"), el(containers.AUDIO, el(containers.CHANNELS, num(2)), el(containers.HZ, struct.pack(">d", 44100))))
    block = lambda n, shift, flags, data: vsize(n, 1) + struct.pack(">hB", shift, flags) + data
    xiph = bytes([2, 3, 4]) + b"aaa" + b"bbbb" + b"cc"
    ebml = bytes([2]) + vsize(5, 1) + vsize(2 + 63, 1) + b"ddddd" + b"eeeeeee" + b"f"
    first = el(containers.CLUSTER, el(containers.TIME, num(0)), el(containers.SIMPLE, block(1, 0, 0x80, b"key")), el(containers.SIMPLE, block(1, 40, 0, b"next")), el(containers.SIMPLE, block(2, 5, 0x80 | 2, xiph)))
    second = el(containers.CLUSTER, el(containers.TIME, num(1000)), el(containers.GROUP, el(containers.PLAIN, block(1, 0, 0, b"delta")), el(containers.REFERENCE, b"\x7f")), el(containers.GROUP, el(containers.PLAIN, block(2, 0, 6, ebml)), el(containers.LASTS, num(30))), el(containers.SIMPLE, block(2, 90, 4, bytes([1]) + b"xxyy")))
    data = el(0x1A45DFA3, b"") + (containers.SEGMENT).to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + el(containers.INFO, el(containers.SCALE, num(1_000_000))) + el(containers.TRACKS, track, audio) + first + second
    info, packets = containers.read_mkv(data)
    assert [(s["type"], s["codec"]) for s in info["streams"]] == [("vids", "V_AV1"), ("auds", "A_PCM")] and info["streams"][1]["hz"] == 44100
    video = [(p["pts"], p["duration"], p["is_keyframe"], p["data"]) for p in packets if p["stream_index"] == 0]
    assert video == [(0, 40, True, b"key"), (40, 40, False, b"next"), (1000, 40, False, b"delta")]
    sound = [(p["pts"], p["data"]) for p in packets if p["stream_index"] == 1]
    assert sound == [(5, b"aaa"), (5, b"bbbb"), (5, b"cc"), (1000, b"ddddd"), (1010, b"eeeeeee"), (1020, b"f"), (1090, b"xx"), (1090, b"yy")]


@pytest.mark.parametrize("channels,bits", [(1, 16), (2, 16), (2, 24), (3, 16)])
def test_flac_round_trip(channels, bits):
    n = 9000
    tone = np.sin(np.arange(n)[:, None] * 0.01 * (1 + np.arange(channels))) * 0.7
    for values in (tone, RNG.uniform(-1, 1, (n, channels)), np.full((n, channels), 0.25), tone[:1], tone[:0]):
        data = containers.write_flac(values.ravel(), 44100, channels, bits)
        rate, c, back = containers.read_flac(data)
        top = (1 << bits - 1) - 1
        assert (rate, c) == (44100, channels) and np.array_equal(np.rint(back * top), np.floor(values.ravel() * top + 0.5))
    plain = len(codecs.write_wav(tone.ravel(), 44100, channels, bits))
    assert len(containers.write_flac(tone.ravel(), 44100, channels, bits)) < 0.8 * plain
    raw = np.floor(tone * top + 0.5).astype("<i4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    assert containers.write_flac(tone.ravel(), 44100, channels, bits)[26:42] == hashlib.md5(raw).digest()
    broken = bytearray(containers.write_flac(tone.ravel(), 44100, channels, bits))
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        containers.read_flac(bytes(broken))


def test_plain_h264():
    frames = [golden()[:46, :, :3], golden()[1:47, ::-1, :3]]
    units = containers.write_h264(frames)
    assert all([u[0] & 31 for u in codecs.nal_units(unit)] == [7, 8, 5] for unit in units)
    for frame, unit in zip(frames, units):
        want = containers.from_yuv420(containers.yuv420(frame))
        assert (containers.read_plain_h264(unit, 64, 46) == want).all()
    data = containers.h264_mp4(frames, 25)
    info, packets = containers.read_mp4(data)
    s = info["streams"][0]
    assert (s["width"], s["height"], s["codec"], len(packets)) == (64, 46, "avc1", 2)
    assert codecs.nal_units(containers.mp4_annex_b(s, packets[0])) == codecs.nal_units(units[0])
    zero = bytes([0, 0, 0, 0, 0, 1, 0, 0, 3, 9])
    assert containers.unescaped(containers.escaped(zero)) == zero and b"\0\0\1" not in containers.escaped(zero)
    with pytest.raises(ValueError):
        containers.write_h264([golden()[:47, :, :3]])


def test_packets_of_files_through_timeline(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/x.avi").write_bytes(avi())
    (tmp_path / "v/y.ivf").write_bytes(codecs.write_ivf([(k, bytes([0x32, 1, 0x20 * (k > 0)])) for k in range(9)], 64, 48, 30, 1))
    stream = {"type": "vids", "codec": "av01", "rate": 90000, "width": 64, "height": 48, "config": b""}
    (tmp_path / "v/z.mp4").write_bytes(containers.write_mp4(stream, sample_packets()))
    sources.register(spark)
    rows = spark.read.format("media_packets").load(f"{tmp_path}/v")
    info = {r.source.rpartition("/")[2]: r for r in timeline.source_info(rows.where("kind = 'vids'")).collect()}
    assert info["y.ivf"].frames == 9 and abs(info["y.ivf"].duration - 0.3) < 1e-9 and info["z.mp4"].keyframes == 2
    assert timeline.every_nth(rows.where("source like '%ivf'"), 4).count() == 3
    assert timeline.speed_up(rows.where("source like '%mp4'"), 2.0).count() == 6
    out = sources.containers.write_container(rows.where("source like '%mp4'"), f"{tmp_path}/out/a.mp4").first()
    assert out.packets == 12
    again = containers.read_mp4((tmp_path / "out/a.mp4").read_bytes())[1]
    assert [p["data"] for p in again] == [p["data"] for p in containers.read_mp4((tmp_path / "v/z.mp4").read_bytes())[1]]
    with pytest.raises(ValueError):
        sources.containers.write_container(rows, "x.avi")


def test_compact_images_and_flac_files(spark, tmp_path):
    from framelake.kernels import image

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(codecs.write_png(golden()))
    (tmp_path / "in/b.png").write_bytes(b"junk")
    turned = files.map_images(sources.read_images(spark, f"{tmp_path}/in"), image.rotate_90)
    rows = {r.path.rpartition("/")[2]: r for r in turned.collect()}
    assert rows["b.png"].error and (rows["a.png"].w, rows["a.png"].h) == (48, 64)
    back = files.encode_compact(turned, "png").collect()
    assert len(back) == 1 and (codecs.read_png(bytes(back[0].content)) == np.rot90(golden(), -1)).all()
    clips = spark.createDataFrame([(1, [0.0, 0.5, -0.5, 1.0] * 30), (2, None)], "clip_id long, samples array<double>")
    for r in files.encode_flac(clips, 8000).collect():
        (tmp_path / f"{r.clip_id}.flac").write_bytes(bytes(r.content))
    got = {r.path.rpartition("/")[2]: r for r in sources.read_audio(spark, str(tmp_path)).collect()}
    assert got["1.flac"].sample_rate == 8000 and np.allclose(got["1.flac"].samples, [0.0, 0.5, -0.5, 1.0] * 30, atol=1e-4) and got["2.flac"].samples == []
    for n in (1, 2, 10):
        (tmp_path / f"in/f{n:04d}.png").write_bytes(codecs.write_png(golden()))
    assert sorted(r.frame_no for r in files.numbered(spark, f"{tmp_path}/in/f%04d.png", 2).collect()) == [2, 10]
    assert files.numbered(spark, f"{tmp_path}/in/g%d.png").count() == 0
    assert image_rows(spark, golden()).count() == 1
