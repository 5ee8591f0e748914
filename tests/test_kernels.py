import math
import struct

import numpy as np
import pytest

from framelake.kernels import audio, codecs, image

RNG = np.random.default_rng(3)


def golden():
    y, x = np.mgrid[0:48, 0:64]
    return np.stack([(5 * x + 3 * y) % 256, 7 * x % 256, 11 * y % 256, np.where((x + y) % 13 == 0, 128, 255)], 2).astype(np.uint8)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(channels):
    picture = RNG.integers(0, 256, (7, 11, channels), dtype=np.uint8)
    assert (codecs.read_png(codecs.write_png(picture)) == picture).all()


def test_png_filters_and_errors():
    import zlib

    picture = golden()[..., :3]
    h, w, n = picture.shape
    rows = []
    for y in range(h):
        kind, line, up = y % 5, picture[y].astype(int), picture[y - 1].astype(int) if y else np.zeros((w, n), int)
        left, corner = np.vstack([np.zeros((1, n), int), line[:-1]]), np.vstack([np.zeros((1, n), int), up[:-1]])
        p = left + up - corner
        d = [abs(p - v) for v in (left, up, corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        guess = [0 * line, left, up, (left + up) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
    data = codecs.PNG_MAGIC + codecs._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + codecs._chunk(b"IDAT", zlib.compress(b"".join(rows))) + codecs._chunk(b"IEND", b"")
    assert (codecs.read_png(data) == picture).all()
    for bad in (b"", b"nope", data[:30] + b"\0" + data[31:]):
        with pytest.raises((ValueError, struct.error)):
            codecs.read_png(bad)


def test_bmp_ppm_gif():
    picture = golden()[..., :3]
    assert (codecs.read_bmp(codecs.write_bmp(picture)) == picture).all()
    assert (codecs.read_ppm(codecs.write_ppm(picture)) == picture).all()
    gif = codecs.write_gif([picture, picture[::-1]], 250)
    assert gif[:6] == b"GIF89a" and gif[-1] == 0x3B and gif.count(b"\x21\xf9\x04") == 2
    assert (unlzw(codecs.lzw(picture.tobytes() * 3)) == picture.tobytes() * 3)


def unlzw(data):
    bits, at, width = int.from_bytes(data, "little"), 0, 9
    table, before, out = {k: bytes([k]) for k in range(256)}, None, []
    n = 258
    while True:
        code = bits >> at & (1 << width) - 1
        at += width
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, n, width, before = {k: bytes([k]) for k in range(256)}, 258, 9, None
            continue
        entry = table[code] if code in table else before + before[:1]
        out.append(entry)
        if before is not None and n < 4096:
            table[n] = before + entry[:1]
            n += 1
        if n >= (1 << width) and width < 12:
            width += 1
        before = entry


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_round_trip(bits):
    s = np.sin(np.arange(200) * 0.1)
    rate, channels, back = codecs.read_wav(codecs.write_wav(s, 8000, 2, bits))
    assert (rate, channels, len(back)) == (8000, 2, 200) and np.abs(back - s).max() <= 2.0 / (1 << bits - 1)
    assert np.allclose(codecs.read_wav(codecs.write_wav(s, 8000, floating=True))[2], s, atol=1e-6)


def test_ivf_and_av1():
    packets = [(0, bytes([0x32, 1, 0x00])), (1, bytes([0x32, 1, 0x20])), (2, bytes([0x32, 1, 0x60]))]
    info, back = codecs.read_ivf(codecs.write_ivf(packets, 64, 48, 30, 1))
    assert (info["width"], info["height"], info["rate"], info["frames"]) == (64, 48, 30, 3)
    assert [p["is_keyframe"] for p in back] == [True, False, True] and [p["data"] for p in back] == [d for _, d in packets]
    assert codecs.leb128(bytes([0xAC, 0x02])) == (300, 2)


def avi():
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    avih = chunk(b"avih", struct.pack("<10I", 33333, 0, 0, 0, 2, 0, 2, 0, 640, 480) + bytes(16))
    video = chunk(b"LIST", b"strl" + chunk(b"strh", b"vidsH264" + bytes(12) + struct.pack("<II", 1, 30) + bytes(20)) + chunk(b"strf", bytes(40)))
    sound = chunk(b"LIST", b"strl" + chunk(b"strh", b"auds\0\0\0\0" + bytes(12) + struct.pack("<II", 1, 44100) + bytes(20)) + chunk(b"strf", struct.pack("<HHIIHH", 0x55, 2, 44100, 176400, 4, 16)))
    movi = chunk(b"LIST", b"movi" + chunk(b"00dc", b"\1\2\3\4") + chunk(b"01wb", bytes(16)) + chunk(b"00dc", b"\5\6\7\10") + chunk(b"01wb", bytes(32)))
    body = b"AVI " + chunk(b"LIST", b"hdrl" + avih + video + sound) + movi
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_avi():
    info, packets = codecs.read_avi(avi())
    assert (info["width"], info["height"], info["frames"], info["us_per_frame"]) == (640, 480, 2, 33333)
    assert info["streams"][0]["codec"] == "H264" and info["streams"][1]["hz"] == 44100
    assert [(p["stream_index"], p["pts"], p["duration"], p["is_keyframe"]) for p in packets] == [(0, 0, 1, True), (1, 0, 4, True), (0, 1, 1, False), (1, 4, 8, True)]


def test_h264_forms():
    assert codecs.annex_b_to_avcc(bytes.fromhex("0000000165010203")) == bytes.fromhex("0000000465010203")
    assert codecs.parameter_sets(bytes.fromhex("000000016764001f0000000168ee3c80")) == (bytes.fromhex("6764001f"), bytes.fromhex("68ee3c80"))
    assert codecs.avcc_to_annex_b(bytes.fromhex("000000026742") + bytes.fromhex("0000000368ce06")) == bytes.fromhex("000000016742" + "0000000168ce06")
    with pytest.raises(ValueError):
        codecs.avcc_to_annex_b(bytes.fromhex("00000009aa"))


def test_exif_and_ogg():
    text = b"2024:01:02 03:04:05\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0132, 2, len(text), 26) + struct.pack("<I", 0) + text
    assert codecs.read_exif(tiff) == {"DateTime": "2024:01:02 03:04:05"}
    with pytest.raises(ValueError):
        codecs.read_exif(b"not exif at all")
    pages = codecs.ogg_pages(codecs.write_ogg([b"OpusHead", b"x" * 600], [0, 960]))
    assert [p["body"] for p in pages] == [b"OpusHead", b"x" * 600] and all(p["ok"] for p in pages) and pages[1]["lacing"] == [255, 255, 90]


def test_image_kernels():
    picture = golden()
    assert (image.resize_lanczos(picture, 64, 48) == picture).all() and image.resize_lanczos(picture, 20, 10).shape == (10, 20, 4)
    flat = np.full((20, 30, 3), 77, np.uint8)
    assert (image.gaussian_blur(flat, 2.0) == 77).all() and (image.resize_lanczos(flat, 7, 5) == 77).all()
    assert (image.rotate_90(image.rotate_90(image.rotate_90(image.rotate_90(picture)))) == picture).all()
    assert image.rotate_90(picture)[0, 47].tolist() == picture[0, 0].tolist()
    double = lambda part: part.repeat(2, 0).repeat(2, 1)
    assert (image.upscale_tiled(picture, double, 2, tile=16, overlap=4) == double(picture)).all()
    two = np.zeros((16, 16, 4), np.uint8)
    two[:, :8, 0], two[:, 8:, 2] = 255, 255
    assert image.vectorize(two).count("<path") == 2
    with pytest.raises(ValueError):
        image.vectorize(two, levels=1)
    boxed = image.draw_boxes(picture, [(5, 5, 20, 15)], [(10, 10)])
    assert boxed[5, 5, :3].tolist() == [0, 255, 0] and boxed[10, 10, :3].tolist() == [255, 0, 0]
    assert image.draw_pose(picture, [(0.5, 0.5, 1.0)] * 17)[24, 32].tolist() != picture[24, 32].tolist()
    assert image.render_waveform([(-1, 1), (0, 0)], 20).shape == (20, 2, 3) and image.render_bars(np.array([1.0, 0.25]), 10, 4).shape == (10, 4, 3)


def loop_delay(x, n, feedback, wet):
    line, out = [0.0] * n, []
    for t, v in enumerate(x):
        old = line[t % n]
        line[t % n] = v + old * feedback
        out.append(v * (1 - wet) + old * wet)
    return out


def test_delay_and_one_pole_against_loops():
    x = RNG.normal(size=(3, 400))
    for n in (1, 7, 390, 500):
        got = audio.delay(x, 1000, n, 0.6, 0.4)
        assert np.allclose(got, [loop_delay(r, n, 0.6, 0.4) for r in x])
    y = audio.one_pole(x, 0.9)
    want = np.zeros_like(x)
    for t in range(400):
        want[:, t] = x[:, t] + (0.9 * want[:, t - 1] if t else 0)
    assert np.allclose(y, want)


def test_reverb_against_a_loop():
    x, rate = RNG.normal(size=2000) * 0.3, 8000
    room, damping, wet, pre = audio.REVERBS["hall"]
    lines = [np.zeros(int(c * rate / 44100)) for c in audio.COMBS]
    passes = [np.zeros(int(c * rate / 44100)) for c in audio.ALL_PASS]
    low, out, first = [0.0] * 8, [], np.zeros(int(pre * rate / 1000))
    for t, v in enumerate(x):
        k = t % len(first)
        source, first[k] = first[k] * 0.015, v
        total = 0.0
        for j, line in enumerate(lines):
            k = t % len(line)
            heard = line[k]
            low[j] = heard * (1 - damping * 0.4) + low[j] * damping * 0.4
            line[k] = source + low[j] * (room * 0.28 + 0.7)
            total += heard
        for line in passes:
            k = t % len(line)
            heard = line[k]
            line[k] = total - heard * 0.5
            total += heard * 0.5
        out.append(v * (1 - wet) + total * wet)
    assert np.allclose(audio.reverb(x[None], rate, room, damping, wet, pre)[0], out, atol=1e-9)


def test_equalizer_keeps_what_it_should():
    t = np.arange(4000) / 8000
    for hz, kind, low, high in ((50, "low_pass", 0.9, 1.1), (3000, "low_pass", 0.0, 0.2), (3000, "high_pass", 0.9, 1.1), (50, "high_pass", 0.0, 0.1), (1000, "notch", 0.0, 0.1)):
        y = audio.biquad(np.sin(2 * math.pi * hz * t)[None], audio.biquad_coefficients(kind, 1000, 0, 0.707, 8000))
        assert low <= np.abs(y[0, 2000:]).max() <= high
    for kind in ("peak", "low_shelf", "high_shelf"):
        assert np.allclose(audio.biquad_coefficients(kind, 500, 0, 1, 8000)[:3], (1, *audio.biquad_coefficients(kind, 500, 0, 1, 8000)[3:]))
    for name, (f, extra) in {"chorus": (audio.chorus, {}), "flanger": (audio.flanger, {})}.items():
        assert f(np.sin(t)[None], 8000, **extra).shape == (1, 4000), name
