"""MP4 and Matroska as packets, MP4 writing, FLAC, and H.264 pictures without compression; no Spark here.

Readers give stream facts and packets like those of kernels.codecs: pts, dts, duration (in the stream's clock), is_keyframe,
stream_index, data. Packets are copied, never decoded, but for H.264 written here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from .codecs import annex_b_to_avcc, avcc_to_annex_b, parameter_sets


# --- MP4 ---


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes in a range; a size of 0 goes to the end, of 1 is 64 bits long."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError("bad MP4 box")
        yield kind, at + head, at + size
        at += size


def find(data: bytes, path: str, at: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """The ranges of all boxes at a path such as moov/trak."""
    ranges = [(at, len(data) if end is None else end)]
    for name in path.split("/"):
        ranges = [(s, e) for a, b in ranges for kind, s, e in boxes(data, a, b) if kind == name.encode()]
    return ranges


def _table(data: bytes, at: int, form: str) -> list[tuple]:
    n = struct.unpack(">I", data[at + 4 : at + 8])[0]
    return list(struct.iter_unpack(">" + form, data[at + 8 : at + 8 + n * struct.calcsize(">" + form)]))


def read_mp4(data: bytes) -> tuple[dict, list[dict]]:
    """Streams (type, codec, clock, width, height or channels, hz, and the decoder's configuration) and their packets by offset."""
    if not any(kind == b"moov" for kind, *_ in boxes(data)):
        raise ValueError("not an MP4 file with an index")
    streams, packets = [], []
    for k, (a, b) in enumerate(find(data, "moov/trak")):
        one = lambda path: next(iter(find(data, path, a, b)), None)  # noqa: B023, E731
        head, kind = one("mdia/mdhd"), one("mdia/hdlr")
        clock = struct.unpack(">I", data[head[0] + (20 if data[head[0]] else 12) :][:4])[0]
        stream = {"type": {b"vide": "vids", b"soun": "auds"}.get(data[kind[0] + 8 : kind[0] + 12], "other"), "rate": clock, "scale": 1}
        table = "mdia/minf/stbl/"
        entry = one(table + "stsd")
        if entry:
            stream["codec"] = data[entry[0] + 12 : entry[0] + 16].decode("latin-1")
            body = entry[0] + 16
            if stream["type"] == "vids":
                stream["width"], stream["height"] = struct.unpack(">HH", data[body + 24 : body + 28])
                stream["config"] = next((data[s:e] for kind, s, e in boxes(data, body + 78, entry[1]) if kind in (b"avcC", b"av1C", b"hvcC", b"vpcC")), b"")
            elif stream["type"] == "auds":
                stream["channels"], stream["hz"] = struct.unpack(">H", data[body + 16 : body + 18])[0], struct.unpack(">I", data[body + 24 : body + 28])[0] >> 16
        sizes_at = one(table + "stsz")[0]
        fixed, n = struct.unpack(">II", data[sizes_at + 4 : sizes_at + 12])
        sizes = [fixed] * n if fixed else list(struct.unpack(f">{n}I", data[sizes_at + 12 : sizes_at + 12 + 4 * n]))
        chunk = [c for c, in _table(data, one(table + "stco")[0], "I")] if one(table + "stco") else [c for c, in _table(data, one(table + "co64")[0], "Q")]
        runs = _table(data, one(table + "stsc")[0], "III")
        durations = [d for count, d in _table(data, one(table + "stts")[0], "II") for _ in range(count)]
        shifts = [d for count, d in _table(data, one(table + "ctts")[0], "Ii") for _ in range(count)] if one(table + "ctts") else [0] * n
        keys = {s for s, in _table(data, one(table + "stss")[0], "I")} if one(table + "stss") else None
        i, dts = 0, 0
        for number, offset in enumerate(chunk, 1):
            count = [r[1] for r in runs if r[0] <= number][-1]
            for _ in range(min(count, n - i)):
                step = durations[i] if i < len(durations) else 0
                packets.append({"pts": dts + shifts[i], "dts": dts, "duration": step, "is_keyframe": keys is None or i + 1 in keys, "stream_index": k, "data": data[offset : offset + sizes[i]], "at": offset})
                offset, dts, i = offset + sizes[i], dts + step, i + 1
        streams.append(stream)
    packets.sort(key=lambda p: p["at"])
    return {"streams": streams}, [{c: v for c, v in p.items() if c != "at"} for p in packets]


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


#: The matrix of a picture that is not turned.
UNTURNED = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def write_mp4(stream: dict, packets: list[dict]) -> bytes:
    """One stream in one chunk behind its index; stream as read_mp4 gives it, with the codec's four letters and its config."""
    n, clock = len(packets), stream["rate"]
    length = sum(p["duration"] for p in packets)
    video = stream["type"] == "vids"
    if video:
        config = box({"avc1": "avcC", "av01": "av1C", "hvc1": "hvcC"}.get(stream["codec"], "vpcC"), stream["config"]) if stream.get("config") else b""
        entry = box(stream["codec"], bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", stream["width"], stream["height"], 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 24, -1), config)
        media, handler = box("vmhd", struct.pack(">I", 1), bytes(8)), b"vide"
    else:
        entry = box(stream["codec"], bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHII", stream["channels"], 16, 0, stream["hz"] << 16))
        media, handler = box("smhd", bytes(8)), b"soun"
    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    tables = [
        full("stsd", struct.pack(">I", 1), entry),
        full("stts", struct.pack(">I", n), *(struct.pack(">II", 1, p["duration"]) for p in packets)),
        full("stsc", struct.pack(">IIII", 1, 1, max(1, n), 1)),
        full("stsz", struct.pack(">II", 0, n), *(struct.pack(">I", len(p["data"])) for p in packets)),
    ]
    if any(p["pts"] != p["dts"] for p in packets):
        tables.append(box("ctts", struct.pack(">II", 1 << 24, n), *(struct.pack(">Ii", 1, p["pts"] - p["dts"]) for p in packets)))
    if not all(p["is_keyframe"] for p in packets):
        keys = [k for k, p in enumerate(packets, 1) if p["is_keyframe"]]
        tables.append(full("stss", struct.pack(">I", len(keys)), *(struct.pack(">I", k) for k in keys)))
    head = box("ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    w, h = (stream.get("width", 0), stream.get("height", 0)) if video else (0, 0)

    def moov(offset: int) -> bytes:
        stbl = box("stbl", *tables, full("stco", struct.pack(">II", 1, offset)))
        minf = box("minf", media, box("dinf", full("dref", struct.pack(">I", 1), box("url ", struct.pack(">I", 1)))), stbl)
        mdia = box("mdia", full("mdhd", struct.pack(">IIIIHH", 0, 0, clock, length, 0x55C4, 0)), full("hdlr", bytes(4), handler, bytes(12), b"media\0"), minf)
        tkhd = box("tkhd", struct.pack(">I", 7), struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0 if video else 0x100, 0), UNTURNED, struct.pack(">II", w << 16, h << 16))
        mvhd = full("mvhd", struct.pack(">IIIII", 0, 0, clock, length, 1 << 16), struct.pack(">H", 0x100), bytes(10), UNTURNED, bytes(24), struct.pack(">I", 2))
        return box("moov", mvhd, box("trak", tkhd, mdia))

    body = b"".join(p["data"] for p in packets)
    index = moov(len(head) + len(moov(0)) + 8)
    return head + index + struct.pack(">I4s", 8 + len(body), b"mdat") + body


def avc_config(sps: bytes, pps: bytes) -> bytes:
    """The decoder's configuration of H.264 in MP4."""
    return bytes([1, *sps[1:4], 0xFF, 0xE1]) + struct.pack(">H", len(sps)) + sps + b"\1" + struct.pack(">H", len(pps)) + pps


def config_sets(config: bytes) -> tuple[bytes, bytes]:
    n = struct.unpack(">H", config[6:8])[0]
    at = 8 + n + 1
    m = struct.unpack(">H", config[at : at + 2])[0]
    return config[8 : 8 + n], config[at + 2 : at + 2 + m]


# --- Matroska ---


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """A variable-length number (None: unknown size) and where it ends; keep leaves the length marker in, as ids have it."""
    first = data[at]
    size = 9 - first.bit_length()
    if size > 8:
        raise ValueError("bad EBML number")
    value = int.from_bytes(data[at : at + size], "big")
    if not keep:
        value &= (1 << 7 * size) - 1
        if value == (1 << 7 * size) - 1:
            return None, at + size
    return value, at + size


#: Matroska's ids of the elements that are read.
SEGMENT, INFO, SCALE, TRACKS, TRACK, NUMBER, KIND, CODEC, PRIVATE = 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x63A2
VIDEO, WIDTH, HEIGHT, AUDIO, CHANNELS, HZ, DEFAULT = 0xE0, 0xB0, 0xBA, 0xE1, 0x9F, 0xB5, 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, PLAIN, LASTS, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        name, at = vint(data, at, True)
        size, at = vint(data, at)
        stop = end if size is None else min(end, at + size)
        yield name, at, stop
        at = stop


def laced(data: bytes, at: int, end: int, flags: int) -> list[bytes]:
    """The frames of a block, which may hold several under one head."""
    how = flags >> 1 & 3
    if not how:
        return [data[at:end]]
    n, at, sizes = data[at] + 1, at + 1, []
    if how == 2:
        sizes = [(end - at) // n] * n
    elif how == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            value, after = vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1))
            at = after
    sizes += [end - at - sum(sizes)] * (len(sizes) < n)
    out = []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def read_mkv(data: bytes) -> tuple[dict, list[dict]]:
    """Streams and packets of Matroska and WebM; the clock is 1/1000 s unless the file sets another."""
    if data[:4] != b"\x1a\x45\xdf\xa3":
        raise ValueError("not a Matroska file")
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    streams: dict[int, dict] = {}
    packets, scale = [], 1_000_000

    def add(a: int, b: int, time: int, lasts: int | None, key: bool | None) -> None:
        track, at = vint(data, a)
        shift, flags = struct.unpack(">hB", data[at : at + 3])
        stream = streams.get(track, {"index": 0, "step": 0})
        parts = laced(data, at + 3, b, flags)
        step = (lasts or 0) // len(parts) if lasts else stream["step"] // scale
        for k, part in enumerate(parts):
            pts = time + shift + k * step
            packets.append({"pts": pts, "dts": pts, "duration": step, "is_keyframe": bool(flags & 0x80) if key is None else key, "stream_index": stream["index"], "data": part})

    for name, a, b in elements(data, 0, len(data)):
        if name != SEGMENT:
            continue
        for part, c, d in elements(data, a, b):
            if part == INFO:
                scale = next((number(s, e) for n, s, e in elements(data, c, d) if n == SCALE), scale)
            elif part == TRACKS:
                for n, s, e in elements(data, c, d):
                    if n == TRACK:
                        f = {k: (x, y) for k, x, y in elements(data, s, e)}
                        stream = {"index": len(streams), "type": {1: "vids", 2: "auds"}.get(number(*f[KIND]), "other"), "codec": data[slice(*f[CODEC])].decode("latin-1"), "config": data[slice(*f[PRIVATE])] if PRIVATE in f else b"", "step": number(*f[DEFAULT]) if DEFAULT in f else 0}
                        for group in (VIDEO, AUDIO):
                            for k, x, y in elements(data, *f[group]) if group in f else ():
                                if k in (WIDTH, HEIGHT, CHANNELS):
                                    stream[{WIDTH: "width", HEIGHT: "height", CHANNELS: "channels"}[k]] = number(x, y)
                                elif k == HZ:
                                    stream["hz"] = int(struct.unpack(">f" if y - x == 4 else ">d", data[x:y])[0])
                        streams[number(*f[NUMBER])] = stream
            elif part == CLUSTER:
                time = 0
                for n, s, e in elements(data, c, d):
                    if n == TIME:
                        time = number(s, e)
                    elif n == SIMPLE:
                        add(s, e, time, None, None)
                    elif n == GROUP:
                        f = {k: (x, y) for k, x, y in elements(data, s, e)}
                        add(*f[PLAIN], time, number(*f[LASTS]) if LASTS in f else None, REFERENCE not in f)
    found = [{k: v for k, v in s.items() if k not in ("index", "step")} | {"rate": 1_000_000_000, "scale": scale} for s in streams.values()]
    return {"streams": found}, packets


# --- H.264 without compression ---


class Bits:
    """A string of bits, written from the highest on."""

    def __init__(self) -> None:
        self.text: list[str] = []

    def u(self, value: int, n: int) -> Bits:
        self.text.append(format(value, f"0{n}b"))
        return self

    def ue(self, value: int) -> Bits:
        bits = format(value + 1, "b")
        self.text.append("0" * (len(bits) - 1) + bits)
        return self

    def bytes(self, stop: bool = True) -> bytes:
        bits = "".join(self.text) + "1" * stop
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def escaped(unit: bytes) -> bytes:
    """A unit in which 00 00 0x can't be taken for a start code."""
    if b"\0\0" not in unit:
        return unit
    out, zeros = bytearray(), 0
    for b in unit:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def unescaped(unit: bytes) -> bytes:
    return unit.replace(b"\0\0\3", b"\0\0")


def yuv420(image: np.ndarray) -> list[np.ndarray]:
    """Planes Y, Cb, Cr (BT.601, studio range), the last two at half size; sides are even."""
    v = image[..., :3].astype(float)
    r, g, b = v[..., 0], v[..., 1], v[..., 2]
    y = 16 + (65.481 * r + 128.553 * g + 24.966 * b) / 255
    cb, cr = 128 + (-37.797 * r - 74.203 * g + 112.0 * b) / 255, 128 + (112.0 * r - 93.786 * g - 18.214 * b) / 255
    half = lambda p: p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3))
    return [np.floor(np.clip(p, 0, 255) + 0.5).astype(np.uint8) for p in (y, half(cb), half(cr))]


def from_yuv420(planes: list[np.ndarray]) -> np.ndarray:
    y = (planes[0].astype(float) - 16) * 255 / 219
    cb, cr = (np.repeat(np.repeat(p.astype(float) - 128, 2, 0), 2, 1) * 255 / 224 for p in planes[1:])
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.floor(np.clip(rgb, 0, 255) + 0.5).astype(np.uint8)


def write_h264(frames: list[np.ndarray]) -> list[bytes]:
    """Each frame (sides even) as an Annex B access unit of key pictures whose macroblocks are plain samples.

    Any H.264 decoder reads them; nothing is predicted, so the stream is as long as its samples.
    """
    out = []
    for k, image in enumerate(frames):
        h, w = image.shape[:2]
        if h % 2 or w % 2 or not h or not w:
            raise ValueError("sides must be even")
        mw, mh = -(-w // 16), -(-h // 16)
        crop = (mw * 16 - w, mh * 16 - h)
        sps = Bits().u(66, 8).u(0xC0, 8).u(40, 8).ue(0).ue(0).ue(2).ue(1).u(0, 1).ue(mw - 1).ue(mh - 1).u(1, 1).u(1, 1).u(int(any(crop)), 1)
        if any(crop):
            sps.ue(0).ue(crop[0] // 2).ue(0).ue(crop[1] // 2)
        sps.u(0, 1)
        pps = Bits().ue(0).ue(0).u(0, 1).u(0, 1).ue(0).ue(0).ue(0).u(0, 1).u(0, 2).ue(0).ue(0).ue(0).u(1, 1).u(0, 1).u(0, 1)
        # a slice of key picture k: first macroblock, type I, sets, frame number, picture, references, quantiser, no deblocking
        head = Bits().ue(0).ue(7).ue(0).u(0, 4).ue(k % 2).u(0, 1).u(0, 1).ue(0).ue(1)
        planes = yuv420(np.pad(image, ((0, crop[1]), (0, crop[0]), (0, 0)), mode="edge"))
        blocks = [p.reshape(mh, s, mw, s).transpose(0, 2, 1, 3).reshape(mh * mw, s * s) for p, s in zip(planes, (16, 8, 8))]
        body = np.concatenate(blocks, 1)
        bits = "".join(head.text)
        parts = []
        for row in body:
            bits += "000011010"  # ue(25): plain samples
            bits = bits.ljust(-(-len(bits) // 8) * 8, "0")
            parts.append(int(bits, 2).to_bytes(len(bits) // 8, "big") + row.tobytes())
            bits = ""
        unit = b"".join(parts) + b"\x80"
        out.append(b"".join(b"\0\0\0\1" + u for u in (b"\x67" + escaped(sps.bytes()), b"\x68" + escaped(pps.bytes()), b"\x65" + escaped(unit))))
    return out


def read_plain_h264(unit: bytes, width: int, height: int) -> np.ndarray:
    """The picture of an access unit of write_h264."""
    from .codecs import nal_units

    data = unescaped(next(u for u in nal_units(unit) if u and u[0] & 31 == 5))[1:]
    mw, mh = -(-width // 16), -(-height // 16)
    first = len(data) - 1 - mw * mh * 384 - 2 * (mw * mh - 1)
    rows = np.stack([np.frombuffer(data, np.uint8, 384, first + k * 386) for k in range(mw * mh)])
    planes, at = [], 0
    for s in (16, 8, 8):
        planes.append(rows[:, at : at + s * s].reshape(mh, mw, s, s).transpose(0, 2, 1, 3).reshape(mh * s, mw * s))
        at += s * s
    return from_yuv420(planes)[:height, :width]


def h264_mp4(frames: list[np.ndarray], rate: int = 30, scale: int = 1) -> bytes:
    units = write_h264(frames)
    sps, pps = parameter_sets(units[0])
    stream = {"type": "vids", "codec": "avc1", "rate": rate, "width": frames[0].shape[1], "height": frames[0].shape[0], "config": avc_config(sps, pps)}
    packets = [{"pts": k * scale, "dts": k * scale, "duration": scale, "is_keyframe": True, "data": annex_b_to_avcc(u)} for k, u in enumerate(units)]
    return write_mp4(stream, packets)


def mp4_annex_b(stream: dict, packet: dict) -> bytes:
    """An MP4 packet of H.264 with its parameter sets and start codes."""
    sps, pps = config_sets(stream["config"])
    return avcc_to_annex_b(packet["data"], 4, b"\0\0\0\1" + sps + b"\0\0\0\1" + pps)


# --- FLAC ---


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for k in range(256):
        v = k << bits - 8
        for _ in range(8):
            v = (v << 1 ^ poly if v & top else v << 1) & mask
        out.append(v)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    v = 0
    for b in data:
        v = CRC8[v ^ b]
    return v


def crc16(data: bytes) -> int:
    v = 0
    for b in data:
        v = (v << 8 & 0xFFFF) ^ CRC16[v >> 8 ^ b]
    return v


def utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF << 8 - size & 0xFF) if size < 7 else 0xFE
    return bytes([lead | n >> 6 * (size - 1), *(0x80 | n >> 6 * k & 0x3F for k in range(size - 2, -1, -1))])


BLOCK = 4096


def _rice(values: np.ndarray, order: int) -> str:
    """Residuals in one partition of the parameter that takes the fewest bits."""
    folded = np.where(values >= 0, 2 * values, -2 * values - 1)
    sizes = [int((folded >> k).sum()) + len(folded) * (k + 1) for k in range(15)]
    k = int(np.argmin(sizes))
    low = [format(v, f"0{k}b") for v in (folded & ((1 << k) - 1)).tolist()] if k else [""] * len(folded)
    return "00" + "0000" + format(k, "04b") + "".join("0" * q + "1" + r for q, r in zip((folded >> k).tolist(), low))


def write_flac(samples: np.ndarray, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """FLAC of interleaved samples in -1..1, with fixed predictors of the order that takes least in each block."""
    import hashlib

    if bits not in (16, 24) or not 1 <= channels <= 8 or not 0 < rate < 1 << 20:
        raise ValueError("unsupported FLAC format")
    top = (1 << bits - 1) - 1
    values = np.floor(np.clip(np.asarray(samples, float), -1, 1) * top + 0.5).astype(np.int64)
    values = values[: len(values) // channels * channels].reshape(-1, channels)
    raw = values.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    n = len(values)
    info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | n).to_bytes(8, "big") + hashlib.md5(raw).digest()
    out = [b"fLaC", bytes([0x80]), struct.pack(">I", len(info))[1:], info]
    for number, a in enumerate(range(0, n, BLOCK)):
        block = values[a : a + BLOCK]
        head = bytes([0xFF, 0xF8, 0x70, channels - 1 << 4 | {16: 4, 24: 6}[bits] << 1]) + utf8_number(number) + struct.pack(">H", len(block) - 1)
        text = []
        for c in range(channels):
            x = block[:, c]
            diffs = [np.diff(x, order) for order in range(min(4, len(x) - 1) + 1)]
            order = int(np.argmin([np.abs(d).sum() for d in diffs]))
            two = (1 << bits) - 1
            warm = "".join(format(v & two, f"0{bits}b") for v in x[:order].tolist())
            if (x == x[0]).all():
                text.append("00000000" + format(int(x[0]) & two, f"0{bits}b"))
            elif int(np.abs(diffs[order]).max(initial=0)) >= 1 << bits + 3:
                text.append("00000010" + "".join(format(v & two, f"0{bits}b") for v in x.tolist()))
            else:
                text.append("0" + format(8 + order, "06b") + "0" + warm + _rice(diffs[order], order))
        joined = "".join(text)
        joined = joined.ljust(-(-len(joined) // 8) * 8, "0")
        frame = head + bytes([crc8(head)]) + int("1" + joined, 2).to_bytes(len(joined) // 8 + 1, "big")[1:]
        out.append(frame + struct.pack(">H", crc16(frame)))
    return b"".join(out)


def read_flac(data: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and interleaved samples in -1..1: constant, plain, fixed and linear predictors, and stereo differences."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, last, info = 4, False, None
    while not last:
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
    facts = int.from_bytes(info[10:18], "big")
    rate, channels, bits, total = facts >> 44, (facts >> 41 & 7) + 1, (facts >> 36 & 31) + 1, facts & (1 << 36) - 1
    parts = []
    while at + 6 < len(data):
        block, at = _flac_frame(data, at, channels, bits)
        parts.append(block)
    values = np.concatenate([*parts, np.zeros((0, channels), np.int64)])
    if total and len(values) != total:
        raise ValueError("FLAC samples are missing")
    return rate, channels, values.ravel() / float((1 << bits - 1) - 1)


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def u(self, n: int) -> int:
        a, b = self.at // 8, -(-(self.at + n) // 8)
        value = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n) & (1 << n) - 1
        self.at += n
        return value

    def s(self, n: int) -> int:
        v = self.u(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def unary(self) -> int:
        n = 0
        while True:
            byte = self.data[self.at // 8] << self.at % 8 & 0xFF
            if byte:
                zeros = 8 - byte.bit_length()
                self.at += zeros + 1
                return n + zeros
            n += 8 - self.at % 8
            self.at += 8 - self.at % 8


def _flac_frame(data: bytes, at: int, channels: int, bits: int) -> tuple[np.ndarray, int]:
    if data[at] != 0xFF or data[at + 1] & 0xFC != 0xF8:
        raise ValueError("FLAC frame expected")
    code, rate_code, mode, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    k = at + 4
    k += 1 if data[k] < 0x80 else 8 - (data[k] ^ 0xFF).bit_length()
    if code in (6, 7):
        n, k = int.from_bytes(data[k : k + code - 5], "big") + 1, k + code - 5
    else:
        n = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    k += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[at:k]) != data[k]:
        raise ValueError("bad FLAC header checksum")
    bits = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}.get(depth, bits)
    r = _Reader(data, k + 1)
    rows = [_subframe(r, n, bits + (mode == 8 and c == 1 or mode == 9 and c == 0 or mode == 10 and c == 1)) for c in range(2 if mode >= 8 else mode + 1)]
    if mode == 8:
        rows[1] = rows[0] - rows[1]
    elif mode == 9:
        rows[0] = rows[0] + rows[1]
    elif mode == 10:
        middle = 2 * rows[0] + (rows[1] & 1)
        rows = [middle + rows[1] >> 1, middle - rows[1] >> 1]
    end = -(-r.at // 8)
    if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("bad FLAC frame checksum")
    return np.stack(rows, 1), end + 2


def _subframe(r: _Reader, n: int, bits: int) -> np.ndarray:
    r.u(1)
    kind = r.u(6)
    waste = r.unary() + 1 if r.u(1) else 0
    bits -= waste
    if kind == 0:
        return np.full(n, r.s(bits) << waste, np.int64)
    if kind == 1:
        return np.array([r.s(bits) << waste for _ in range(n)], np.int64)
    fixed = 8 <= kind <= 12
    order = kind - 8 if fixed else kind - 31
    if not fixed and kind < 32:
        raise ValueError("reserved FLAC subframe")
    x = [r.s(bits) for _ in range(order)]
    shift, weights = 0, [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order] if fixed else ()
    if not fixed:
        precision = r.u(4) + 1
        shift = r.s(5)
        weights = [r.s(precision) for _ in range(order)]
    wide, parts = (4, 5)[r.u(2)], 1 << r.u(4)
    for part in range(parts):
        count, k = n // parts - (order if part == 0 else 0), r.u(wide)
        plain = r.u(5) if k == (1 << wide) - 1 else None
        for _ in range(count):
            if plain is not None:
                value = r.s(plain)
            else:
                folded = r.unary() << k | (r.u(k) if k else 0)
                value = folded >> 1 ^ -(folded & 1)
            x.append(value + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
    return np.array(x, np.int64) << waste
