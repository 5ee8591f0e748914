"""File formats in plain Python and numpy: PNG, BMP, PPM, GIF, WAV, IVF, AVI, EXIF, Annex B; no Spark here.

Readers take bytes and give arrays or records; a format error is a ValueError. Images are (height, width, channels) uint8.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(image: np.ndarray, level: int = 1) -> bytes:
    """Rows as differences from the row above, which compress well and fast."""
    h, w, n = image.shape
    rows = np.zeros((h, 1 + w * n), np.uint8)
    flat = image.reshape(h, -1)
    rows[:, 0] = 2
    rows[:1, 1:] = flat[:1]
    np.subtract(flat[1:], flat[:-1], out=rows[1:, 1:])
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Eight-bit images without interlacing; palettes are resolved."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("bad PNG checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("unsupported PNG")
    w, h, n = head[0], head[1], {0: 1, 4: 2, 2: 3, 6: 4, 3: 1}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * n)
    image = unfiltered(raw[:, 0], raw[:, 1:].reshape(h, w, n))
    return palette[image[..., 0]] if head[3] == 3 else image


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The rows of a PNG from their differences.

    Differences from the left or from above are summed row by row; means and Paeth's guess need the pixel before, so for
    them all rows go on together, each one pixel behind the row above.
    """
    h, w, n = lines.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("bad PNG filter")
    if kinds.max(initial=0) <= 2:
        out = lines.copy()
        for y in range(h):
            if kinds[y] == 1:
                np.cumsum(lines[y], 0, dtype=np.uint8, out=out[y])
            elif kinds[y] == 2 and y:
                np.add(lines[y], out[y - 1], out=out[y])
        return out
    out = np.zeros((h + 1, w + 1, n), np.int16)
    kind = kinds.astype(np.int64)[:, None]
    for d in range(w + h - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        k = kind[y]
        guess = np.where(k == 4, paeth, np.where(k == 3, (left + up) >> 1, np.where(k == 2, up, np.where(k == 1, left, 0))))
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def write_bmp(image: np.ndarray) -> bytes:
    rgb = image[..., :3] if image.shape[2] >= 3 else np.repeat(image[..., :1], 3, 2)
    h, w, _ = rgb.shape
    row = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    first, head, w, h, _, bits, kind = struct.unpack("<IIiiHHI", data[10:34])
    if (bits, kind) not in ((8, 0), (24, 0), (24, 3), (32, 0), (32, 3)):
        raise ValueError("unsupported BMP")
    n = bits // 8
    row = (w * n + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, row * abs(h), first).reshape(abs(h), row)[:, : w * n].reshape(abs(h), w, n)
    body = body[::-1] if h > 0 else body
    if bits == 8:
        colors = np.frombuffer(data, np.uint8, (first - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        if body.size and body.max() >= len(colors):
            raise ValueError("a BMP colour outside its palette")
        return colors[body[..., 0]]
    return np.concatenate([body[..., 2::-1], body[..., 3:]], 2)


def write_ppm(image: np.ndarray) -> bytes:
    h, w, n = image.shape
    kind, body = (b"P5", image[..., :1]) if n <= 2 else (b"P6", image[..., :3])
    return kind + f"\n{w} {h}\n255\n".encode() + body.tobytes()


def read_ppm(data: bytes) -> np.ndarray:
    words, at = [], 0
    while len(words) < 4:
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if data[at : at + 1] == b"#":
            end = data.index(b"\n", at)
        elif end > at:
            words.append(data[at:end])
        at = end + 1
    if words[0] not in (b"P5", b"P6") or words[3] != b"255":
        raise ValueError("unsupported PPM")
    w, h, n = int(words[1]), int(words[2]), 1 if words[0] == b"P5" else 3
    return np.frombuffer(data, np.uint8, w * h * n, at).reshape(h, w, n)


def write_gif(frames: list[np.ndarray], delay_ms: int = 100, loops: int = 0) -> bytes:
    """An animation in a fixed palette of 6 x 7 x 6 levels; loops 0: without end."""
    h, w, _ = frames[0].shape
    levels = [np.linspace(0, 255, k).round().astype(np.uint8) for k in (6, 7, 6)]
    palette = np.zeros((256, 3), np.uint8)
    palette[:252] = np.stack(np.meshgrid(*levels, indexing="ij"), -1).reshape(-1, 3)
    out = [b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0), palette.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0"]
    for frame in frames:
        rgb = (frame[..., :3] if frame.shape[2] >= 3 else np.repeat(frame[..., :1], 3, 2)).astype(float)
        q = [np.floor(rgb[..., k] / 255 * (n - 1) + 0.5).astype(int) for k, n in enumerate((6, 7, 6))]
        out.append(b"\x21\xf9\x04\x00" + struct.pack("<H", delay_ms // 10) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08")
        body = lzw((q[0] * 42 + q[1] * 6 + q[2]).astype(np.uint8).tobytes())
        out += [bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255)] + [b"\0"]
    return b"".join(out) + b"\x3b"


def lzw(data: bytes) -> bytes:
    """Variable-width codes of 8-bit data, low bits first."""
    clear, stop = 256, 257
    table = {bytes([k]): k for k in range(256)}
    width, buffer, used, out = 9, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal buffer, used
        buffer |= code << used
        used += width
        while used >= 8:
            out.append(buffer & 255)
            buffer >>= 8
            used -= 8

    put(clear)
    n, now = 258, b""
    for k in range(len(data)):
        more = now + data[k : k + 1]
        if more in table:
            now = more
            continue
        put(table[now])
        if n < 4096:
            table[more] = n
            n += 1
            if n > 1 << width and width < 12:
                width += 1
        else:
            put(clear)
            table, n, width = {bytes([j]): j for j in range(256)}, 258, 9
        now = data[k : k + 1]
    if now:
        put(table[now])
    put(stop)
    return bytes(out) + (bytes([buffer & 255]) if used else b"")


def write_wav(samples: np.ndarray, rate: int, channels: int = 1, bits: int = 16, floating: bool = False) -> bytes:
    """Interleaved samples in -1..1; integers are cut, not rounded."""
    if floating:
        body, bits = samples.astype("<f4").tobytes(), 32
    elif bits == 8:
        body = np.clip(np.trunc(samples * 127 + 128), 0, 255).astype(np.uint8).tobytes()
    elif bits in (16, 24, 32):
        top = (1 << bits - 1) - 1
        whole = np.clip(np.trunc(samples * float(top)), -top - 1, top).astype("<i8")
        body = np.frombuffer(whole.tobytes(), np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
    else:
        raise ValueError(f"unsupported bits {bits}")
    head = struct.pack("<HHIIHH", 3 if floating else 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels, interleaved samples in -1..1."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, b""
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        elif kind == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None:
        raise ValueError("a WAV file without a format")
    kind, channels, rate, _, _, bits = form
    if kind == 3 and bits == 32:
        return rate, channels, np.frombuffer(body, "<f4").astype(float)
    if bits == 8:
        return rate, channels, (np.frombuffer(body, np.uint8).astype(float) - 128) / 127
    n = bits // 8
    wide = np.zeros((len(body) // n, 4), np.uint8)
    wide[:, 4 - n :] = np.frombuffer(body, np.uint8, len(body) // n * n).reshape(-1, n)
    return rate, channels, (wide.view("<i4")[:, 0] >> (32 - bits)) / float((1 << bits - 1) - 1)


def write_ivf(packets: list[tuple[int, bytes]], width: int, height: int, rate: int, scale: int, fourcc: bytes = b"AV01") -> bytes:
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, fourcc, width, height, rate, scale, len(packets), 0)
    return head + b"".join(struct.pack("<IQ", len(p), pts) + p for pts, p in packets)


def leb128(data: bytes, at: int = 0) -> tuple[int, int]:
    """A value and the bytes it takes."""
    value = 0
    for k in range(8):
        byte = data[at + k]
        value |= (byte & 127) << 7 * k
        if not byte & 128:
            return value, k + 1
    raise ValueError("LEB128 value is too long")


def av1_keyframe(data: bytes) -> bool | None:
    """Whether the first frame or frame header of a temporal unit is a key (0) or switch (3) frame; None without one."""
    at = 0
    while at < len(data):
        kind, extended, sized = data[at] >> 3 & 15, data[at] >> 2 & 1, data[at] >> 1 & 1
        at += 1 + extended
        size, used = leb128(data, at) if sized else (len(data) - at, 0)
        at += used
        if kind in (3, 6) and at < len(data):
            return not data[at] >> 7 and data[at] >> 5 & 3 in (0, 3)
        at += size
    return None


def read_ivf(data: bytes) -> tuple[dict, list[dict]]:
    """Stream facts and packets; byte 16 holds the rate, byte 20 the scale of the clock."""
    if data[:4] != b"DKIF":
        raise ValueError("not an IVF file")
    _, size, fourcc, w, h, rate, scale, n, _ = struct.unpack("<HH4sHHIIII", data[4:32])
    at, packets = size, []
    while at + 12 <= len(data):
        length, pts = struct.unpack("<IQ", data[at : at + 12])
        body = data[at + 12 : at + 12 + length]
        key = av1_keyframe(body) if fourcc == b"AV01" else None
        packets.append({"pts": pts, "dts": pts, "duration": 1, "is_keyframe": bool(key) if key is not None else not packets, "stream_index": 0, "data": body})
        at += 12 + length
    return {"codec": fourcc.decode("latin-1"), "width": w, "height": h, "rate": rate, "scale": scale, "frames": n}, packets


def read_avi(data: bytes) -> tuple[dict, list[dict]]:
    """Stream facts and packets of the movi list; keyframes are the first packet and "db" chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    info: dict = {"streams": []}
    packets: list[dict] = []
    clock: dict[int, int] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            body = data[at + 8 : at + 8 + size]
            if kind in (b"LIST", b"RIFF"):
                walk(at + 12, at + 8 + size)
            elif kind == b"avih":
                info["us_per_frame"], info["frames"] = struct.unpack("<I12xI", body[:20])
                info["width"], info["height"] = struct.unpack("<II", body[32:40])
            elif kind == b"strh":
                info["streams"].append({"type": body[:4].decode("latin-1"), "codec": body[4:8].decode("latin-1").strip("\0 "), "scale": struct.unpack("<I", body[20:24])[0], "rate": struct.unpack("<I", body[24:28])[0]})
            elif kind == b"strf" and info["streams"] and info["streams"][-1]["type"] == "auds":
                form = struct.unpack("<HHIIH", body[:14])
                info["streams"][-1] |= {"channels": form[1], "hz": form[2], "bytes_per_second": form[3]}
            elif kind[:2].isdigit() and kind[2:] in (b"dc", b"db", b"wb"):
                k = int(kind[:2])
                stream = info["streams"][k] if k < len(info["streams"]) else {"scale": 1, "rate": 1}
                step = stream["scale"] if kind[2:] != b"wb" else (size * stream["rate"] + stream.get("bytes_per_second", 1) * stream["scale"] // 2) // max(1, stream.get("bytes_per_second", 1) * stream["scale"])
                pts = clock.get(k, 0)
                packets.append({"pts": pts, "dts": pts, "duration": step, "is_keyframe": kind[2:] == b"wb" or kind[2:] == b"db" or k not in clock, "stream_index": k, "data": body})
                clock[k] = pts + step
            at += 8 + size + size % 2

    walk(12, len(data))
    return info, packets


def nal_units(data: bytes) -> list[bytes]:
    """The units between start codes of three or four bytes."""
    starts, at = [], data.find(b"\0\0\1")
    while at >= 0:
        starts.append(at)
        at = data.find(b"\0\0\1", at + 3)
    ends = [*(s - (data[s - 1 : s] == b"\0") for s in starts[1:]), len(data)]
    return [data[s + 3 : e] for s, e in zip(starts, ends)]


def annex_b_to_avcc(data: bytes) -> bytes:
    """Units with their lengths in front; parameter sets go."""
    return b"".join(struct.pack(">I", len(u)) + u for u in nal_units(data) if u and u[0] & 31 not in (7, 8))


def parameter_sets(data: bytes) -> tuple[bytes, bytes] | None:
    found = {u[0] & 31: u for u in reversed(nal_units(data)) if u}
    return (found[7], found[8]) if 7 in found and 8 in found else None


def avcc_to_annex_b(data: bytes, length_size: int = 4, sets: bytes = b"") -> bytes:
    out, at = [sets], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + length_size], "big")
        at += length_size
        if at + size > len(data) or size == 0:
            raise ValueError("truncated sample")
        out.append(b"\0\0\0\1" + data[at : at + size])
        at += size
    return b"".join(out)


#: EXIF tags that are read, and bytes of their types.
EXIF_TAGS = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension"}
EXIF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def read_exif(data: bytes) -> dict[str, str]:
    """Tags of a TIFF block, alone or in a JPEG file."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return read_exif(data[at + 10 : at + 2 + size])
            at += 2 + size
        raise ValueError("a JPEG file without EXIF")
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF block")
    out: dict[str, str] = {}
    todo, seen = [struct.unpack(order + "I", data[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        for k in range(at + 2, min(at + 2 + 12 * n, len(data) - 11), 12):
            tag, kind, count = struct.unpack(order + "HHI", data[k : k + 8])
            size = EXIF_SIZES.get(kind, 1) * count
            where = k + 8 if size <= 4 else struct.unpack(order + "I", data[k + 8 : k + 12])[0]
            raw = data[where : where + size]
            if tag == 0x8769:
                todo.append(struct.unpack(order + "I", raw)[0])
            elif tag in EXIF_TAGS and len(raw) == size:
                if kind == 2:
                    out[EXIF_TAGS[tag]] = raw.split(b"\0")[0].decode("latin-1")
                elif kind in (5, 10):
                    a, b = struct.unpack(order + "II", raw[:8])
                    out[EXIF_TAGS[tag]] = f"{a}/{b}"
                else:
                    out[EXIF_TAGS[tag]] = str(struct.unpack(order + {1: "B", 7: "B", 3: "H", 4: "I", 9: "i"}[kind], raw[: EXIF_SIZES[kind]])[0])
    return out


def ogg_pages(data: bytes) -> list[dict]:
    """Pages of an Ogg stream with checked checksums: serial, number, granule, packets begun or continued."""
    out, at = [], 0
    while at + 27 <= len(data):
        if data[at : at + 4] != b"OggS":
            raise ValueError("lost the Ogg page")
        flags, granule, serial, number, crc, n = struct.unpack("<BqIIIB", data[at + 5 : at + 27])
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : at + size]
        out.append({"flags": flags, "granule": granule, "serial": serial, "number": number, "lacing": list(lacing), "body": data[at + 27 + n : at + size], "ok": ogg_crc(page) == crc})
        at += size
    return out


def ogg_crc(data: bytes) -> int:
    """The polynomial 0x04C11DB7, from 0, without reflection."""
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def write_ogg(packets: list[bytes], granules: list[int], serial: int = 1) -> bytes:
    """One page for each packet (of at most 65025 bytes)."""
    out = []
    for k, (packet, granule) in enumerate(zip(packets, granules)):
        lacing = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        flags = (2 if k == 0 else 0) | (4 if k == len(packets) - 1 else 0)
        head = b"OggS" + struct.pack("<BBqIIIB", 0, flags, granule, serial, k, 0, len(lacing)) + lacing
        page = head + packet
        out.append(page[:22] + struct.pack("<I", ogg_crc(page)) + page[26:])
    return b"".join(out)
