"""JPEG files in plain Python and numpy: baseline and progressive reading, baseline writing; no Spark here.

Readers take bytes and give (height, width, channels) uint8 arrays; a format error is a ValueError. Arithmetic coding,
lossless frames and samples of more than eight bits are not read. Entropy decoding is a Python loop, some seconds for
a megapixel; for folders of large photos sources.read_photos decodes in the JVM.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections import Counter

import numpy as np

#: Places of a block in zigzag order: diagonals, each second one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

#: The example quantisation tables of the JPEG standard (Annex K), in row order.
LUMA_STEPS = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
CHROMA_STEPS = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
])


# ---- reading ----


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits: length of the code they begin with, times 256, plus its symbol; 0 for no code."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            first = code << 16 - length
            table[first : first + (1 << 16 - length)] = length << 8 | symbol
            code += 1
        at += count
        code <<= 1
    return table.tolist()


class _Bits:
    """Bits of one restart interval; words[i] holds the 32 bits from byte i."""

    def __init__(self, data: bytes):
        d = np.frombuffer(data.replace(b"\xff\0", b"\xff") + bytes(12), np.uint8).astype(np.int64)
        self.words = (d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]).tolist()
        self.at, self.size, self.run = 0, 8 * (len(d) - 12), 0

    def symbol(self, table: list[int]) -> int:
        found = table[self.words[self.at >> 3] >> 16 - (self.at & 7) & 0xFFFF]
        if not found:
            raise ValueError("bad JPEG code")
        self.at += found >> 8
        return found & 255

    def take(self, n: int) -> int:
        value = self.words[self.at >> 3] >> 32 - (self.at & 7) - n & (1 << n) - 1
        self.at += n
        return value

    def signed(self, n: int) -> int:
        """A number of n bits, of which the lower half are the negative ones."""
        if not n:
            return 0
        value = self.take(n)
        return value if value >> n - 1 else value - (1 << n) + 1


def _sequential(bits: _Bits, out: array, base: int, part: dict) -> None:
    part["dc"] += bits.signed(bits.symbol(part["dc_table"]))
    out[base] = part["dc"]
    table, k = part["ac_table"], 1
    while k < 64:
        symbol = bits.symbol(table)
        size = symbol & 15
        if size:
            k += symbol >> 4
            if k > 63:
                raise ValueError("bad JPEG run")
            out[base + k] = bits.signed(size)
            k += 1
        elif symbol == 0xF0:
            k += 16
        else:
            return


def _dc_first(bits: _Bits, out: array, base: int, part: dict) -> None:
    part["dc"] += bits.signed(bits.symbol(part["dc_table"]))
    out[base] = part["dc"] << part["low"]


def _dc_next(bits: _Bits, out: array, base: int, part: dict) -> None:
    if bits.take(1):
        out[base] |= 1 << part["low"]


def _ac_first(bits: _Bits, out: array, base: int, part: dict) -> None:
    if bits.run:
        bits.run -= 1
        return
    k, table = part["from"], part["ac_table"]
    while k <= part["to"]:
        symbol = bits.symbol(table)
        run, size = symbol >> 4, symbol & 15
        if size:
            k += run
            if k > 63:
                raise ValueError("bad JPEG run")
            out[base + k] = bits.signed(size) * (1 << part["low"])
            k += 1
        elif run == 15:
            k += 16
        else:
            bits.run = (1 << run) + bits.take(run) - 1
            return


def _ac_next(bits: _Bits, out: array, base: int, part: dict) -> None:
    """One more bit for what is not zero yet, and new values of one step between."""
    k, last, step, table = part["from"], part["to"], 1 << part["low"], part["ac_table"]
    while k <= last and not bits.run:
        symbol = bits.symbol(table)
        zeros, new = symbol >> 4, 0
        if symbol & 15:
            new = step if bits.take(1) else -step
        elif zeros < 15:
            bits.run = (1 << zeros) + bits.take(zeros)
            break
        while k <= last:
            value = out[base + k]
            if value:
                if bits.take(1) and not abs(value) & step:
                    out[base + k] = value + (step if value > 0 else -step)
            elif zeros == 0:
                if new:
                    out[base + k] = new
                k += 1
                break
            else:
                zeros -= 1
            k += 1
    if bits.run:
        for place in range(base + k, base + last + 1):
            value = out[place]
            if value and bits.take(1) and not abs(value) & step:
                out[place] = value + (step if value > 0 else -step)
        bits.run -= 1


def _scan(frame: dict, parts: list[dict], body: list[bytes], restart: int, decode) -> None:
    """Fills the coefficients of the components of one scan."""
    if len(parts) > 1:
        across, down = frame["across"], frame["down"]
        units = [(p, dx, dy, p["h"], p["v"]) for p in parts for dy in range(p["v"]) for dx in range(p["h"])]
    else:
        p = parts[0]
        across, down = -(-p["w"] // 8), -(-p["rows"] // 8)
        units = [(p, 0, 0, 1, 1)]
    total, at = across * down, 0
    for piece in body:
        bits = _Bits(piece)
        for p in parts:
            p["dc"] = 0
        stop = min(total, at + restart) if restart else total
        try:
            while at < stop:
                y, x = divmod(at, across)
                for p, dx, dy, h, v in units:
                    decode(bits, p["data"], ((y * v + dy) * p["stride"] + x * h + dx) * 64, p)
                at += 1
        except (IndexError, OverflowError):
            raise ValueError("truncated or damaged JPEG") from None
        if bits.at > bits.size:
            raise ValueError("truncated JPEG")
    if at < total:
        raise ValueError("truncated JPEG")


def _twice(plane: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples along an axis, each three parts of its own and one of its neighbour."""
    p = np.moveaxis(plane, axis, 0)
    padded = np.concatenate([p[:1], p, p[-1:]])
    out = np.empty((2 * len(p), *p.shape[1:]))
    out[0::2], out[1::2] = (3 * p + padded[:-2]) / 4, (3 * p + padded[2:]) / 4
    return np.moveaxis(out, 0, axis)


def _plane(frame: dict, p: dict) -> np.ndarray:
    """Samples of a component at the size of the image, centred on 0."""
    steps = p["steps"]
    blocks = np.zeros((len(p["data"]) // 64, 64))
    blocks[:, ZIGZAG] = np.frombuffer(p["data"], np.int16).reshape(-1, 64) * steps
    pixels = COSINES.T @ blocks.reshape(-1, 8, 8) @ COSINES
    plane = pixels.reshape(-1, p["stride"], 8, 8).swapaxes(1, 2).reshape(-1, p["stride"] * 8)[: p["rows"], : p["w"]]
    for axis, factor in ((0, frame["v"] / p["v"]), (1, frame["h"] / p["h"])):
        size = (frame["height"], frame["width"])[axis]
        if factor == 2:
            plane = _twice(plane, axis)
        elif factor != 1:
            plane = np.take(plane, np.minimum((np.arange(size) / factor).astype(int), plane.shape[axis] - 1), axis)
        plane = plane[:size] if axis == 0 else plane[:, :size]
    return plane


def _frame(body: bytes, progressive: bool) -> dict:
    precision, height, width, n = struct.unpack(">BHHB", body[:6])
    if precision != 8 or not height or not width or n not in (1, 3, 4) or len(body) < 6 + 3 * n:
        raise ValueError("unsupported JPEG frame")
    parts = [{"id": body[k], "h": body[k + 1] >> 4, "v": body[k + 1] & 15, "table": body[k + 2]} for k in range(6, 6 + 3 * n, 3)]
    if any(not 1 <= p[k] <= 4 for p in parts for k in "hv"):
        raise ValueError("bad JPEG sampling")
    h, v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    for p in parts:
        p |= {"w": -(-width * p["h"] // h), "rows": -(-height * p["v"] // v), "stride": across * p["h"], "steps": None}
        p["data"] = array("h", bytes(128 * across * p["h"] * down * p["v"]))
    return {"width": width, "height": height, "h": h, "v": v, "across": across, "down": down, "parts": parts, "progressive": progressive}


def _entropy(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals from a place on, and the place of the marker after them."""
    pieces, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*pieces, data[start:]], len(data)
        kind = data[at + 1]
        if kind == 0 or kind == 0xFF:
            at += 2 if kind == 0 else 1
            continue
        pieces.append(data[start:at].rstrip(b"\xff") if data[at - 1 : at] == b"\xff" else data[start:at])
        if not 0xD0 <= kind <= 0xD7:
            return pieces, at
        at = start = at + 2


def read_jpeg(data: bytes) -> np.ndarray:
    """Baseline and progressive files; gray ones have one channel, all others three (CMYK as ink over white)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame, restart, adobe, steps, tables, scans = 2, None, 0, None, {}, {}, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("bad JPEG marker")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if len(body) != size - 2:
            raise ValueError("truncated JPEG")
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif kind == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif kind in (0xC0, 0xC1, 0xC2):
            if frame is not None:
                raise ValueError("a second JPEG frame")
            frame = _frame(body, kind == 0xC2)
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("unsupported JPEG coding")
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("a JPEG scan before its frame")
            pieces, at = _entropy(data, at)
            _read_scan(frame, body, pieces, restart, steps, tables)
            scans += 1
    if not scans:
        raise ValueError("truncated JPEG")
    return _colors(frame, [_plane(frame, p) for p in frame["parts"]], adobe)


def _read_scan(frame: dict, body: bytes, pieces: list[bytes], restart: int, steps: dict, tables: dict) -> None:
    parts = []
    for k in range(1, 1 + 2 * body[0], 2):
        p = next((p for p in frame["parts"] if p["id"] == body[k]), None)
        if p is None:
            raise ValueError("unknown JPEG component")
        p |= {"dc_table": tables.get(body[k + 1] >> 4), "ac_table": tables.get(16 | body[k + 1] & 15)}
        p["steps"] = steps.get(p["table"]) if p["steps"] is None else p["steps"]
        if p["steps"] is None:
            raise ValueError("a JPEG table is missing")
        parts.append(p)
    first, last, shift = body[1 + 2 * body[0] : 4 + 2 * body[0]]
    decode = _sequential
    if frame["progressive"]:
        high, low = shift >> 4, shift & 15
        if last > 63 or first > last or first and len(parts) > 1:
            raise ValueError("bad JPEG scan")
        for p in parts:
            p |= {"from": first, "to": last, "low": low}
        decode = (_ac_next if high else _ac_first) if first else (_dc_next if high else _dc_first)
    needs = {_sequential: ("dc_table", "ac_table"), _dc_first: ("dc_table",), _dc_next: ()}.get(decode, ("ac_table",))
    if any(p[k] is None for p in parts for k in needs):
        raise ValueError("a JPEG table is missing")
    _scan(frame, parts, pieces, restart, decode)


def _colors(frame: dict, planes: list[np.ndarray], adobe: int | None) -> np.ndarray:
    rgb = adobe == 0 or adobe is None and [p["id"] for p in frame["parts"]] == [82, 71, 66]
    if len(planes) == 3 and not rgb or len(planes) == 4 and adobe == 2:
        y, cb, cr = (np.clip(np.rint(p), -128, 127) for p in planes[:3])
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb, *planes[3:]]
    image = np.clip(np.rint(np.stack(planes, 2) + 128), 0, 255).astype(np.uint8)
    if len(planes) < 4:
        return image
    ink = image.astype(np.int32) if adobe is not None else 255 - image.astype(np.int32)
    return ((ink[..., :3] * ink[..., 3:] + 127) // 255).astype(np.uint8)


# ---- writing ----


def _codes(counts: Counter) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Best code of at most 16 bits for counted symbols: numbers by length, symbols, and code and length of each symbol.

    A symbol 256 that never occurs takes the code of ones only, which the format forbids.
    """
    lengths = dict.fromkeys([*counts, 256], 0)
    heap = [(n, symbol, [symbol]) for symbol, n in counts.items()] + [(0, 256, [256])]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in a[2] + b[2]:
            lengths[symbol] += 1
        heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
    numbers = [0] * (max(lengths.values()) + 17)
    for length in lengths.values():
        numbers[length] += 1
    for long in range(len(numbers) - 1, 16, -1):
        while numbers[long]:
            short = max(j for j in range(1, long - 1) if numbers[j])
            numbers[long] -= 2
            numbers[long - 1] += 1
            numbers[short + 1] += 2
            numbers[short] -= 1
    numbers[max(j for j in range(17) if numbers[j])] -= 1
    symbols = sorted(counts, key=lambda s: (lengths[s], s))
    codes, sizes, code, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for length in range(1, 17):
        for symbol in symbols[at : at + numbers[length]]:
            codes[symbol], sizes[symbol] = code, length
            code += 1
        at += numbers[length]
        code <<= 1
    return bytes(numbers[1:17]), bytes(symbols), codes, sizes


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _scan_bytes(blocks: np.ndarray, component: int) -> bytes:
    """Tables and entropy-coded scan of one component's quantised blocks in zigzag order."""
    n = len(blocks)
    block, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    values = blocks[block, k]
    before = np.where(np.r_[True, block[1:] != block[:-1]], 0, np.r_[0, k[:-1]]) if len(k) else k
    run = k - before - 1
    full = np.repeat(np.arange(len(k)), run // 16)
    turn = np.arange(len(full)) - np.repeat(np.r_[0, np.cumsum(run // 16)][:-1], run // 16) if len(full) else full
    ends = np.flatnonzero(blocks[:, 63] == 0)
    diffs = np.diff(blocks[:, 0], prepend=0)

    def category(v: np.ndarray) -> np.ndarray:
        return np.frexp(np.abs(v).astype(float))[1].astype(np.int64)

    dc_size, ac_size = category(diffs), category(values)
    # events in the order of the stream: block, place, and full runs of 16 zeros before their value
    key = np.concatenate([np.arange(n) * 260 + 3, block * 260 + k * 4 + 3, block[full] * 260 + k[full] * 4 + turn, ends * 260 + 259])
    symbol = np.concatenate([dc_size, (run % 16) << 4 | ac_size, np.full(len(full), 0xF0), np.zeros(len(ends), np.int64)])
    size = np.concatenate([dc_size, ac_size, np.zeros(len(full) + len(ends), np.int64)])
    value = np.concatenate([diffs, values, np.zeros(len(full) + len(ends), np.int64)])
    is_dc = np.arange(len(key)) < n
    heads, code, length = [], np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for number, chosen in ((0, is_dc), (16, ~is_dc)):
        kinds, times = np.unique(symbol[chosen], return_counts=True)
        numbers, symbols, codes, sizes = _codes(Counter(dict(zip(kinds.tolist(), times.tolist()))) or Counter({0: 1}))
        heads.append(_segment(0xC4, bytes([number]) + numbers + symbols))
        code[chosen], length[chosen] = codes[symbol[chosen]], sizes[symbol[chosen]]
    order = np.argsort(key)
    extra = np.where(value < 0, value + (1 << size) - 1, value)
    word, length = (code << size | extra)[order], (length + size)[order]
    bits = []
    for at in range(0, len(word), 1 << 18):
        w, m = word[at : at + (1 << 18)], length[at : at + (1 << 18)]
        left = np.repeat(np.cumsum(m), m) - np.arange(m.sum()) - 1
        bits.append((np.repeat(w, m) >> left & 1).astype(np.uint8))
    stream = np.concatenate(bits)
    stream = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes()
    return b"".join(heads) + _segment(0xDA, bytes([1, component, 0, 0, 63, 0])) + stream.replace(b"\xff", b"\xff\0")


def write_jpeg(image: np.ndarray, quality: int = 85, subsample: bool = False) -> bytes:
    """A baseline file with a scan and tables made to measure for each component; alpha is left out.

    subsample halves the colour planes in both directions. Sides of 0 or over 65535 are a ValueError.
    """
    h, w, n = image.shape
    if not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError("JPEG sides are 1 to 65535")
    if not 1 <= quality <= 100:
        raise ValueError("JPEG quality is 1 to 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    steps = [np.clip((t * scale + 50) // 100, 1, 255) for t in (LUMA_STEPS, CHROMA_STEPS)]
    if n <= 2:
        planes = [image[..., 0].astype(float) - 128]
    else:
        r, g, b = (image[..., k].astype(float) for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y - 128, (b - y) / 1.772, (r - y) / 1.402]
        if subsample:
            even = [np.pad(p, ((0, h % 2), (0, w % 2)), "edge") for p in planes[1:]]
            planes[1:] = [(p[0::2, 0::2] + p[1::2, 0::2] + p[0::2, 1::2] + p[1::2, 1::2]) / 4 for p in even]
    wide = 0x22 if subsample and n > 2 else 0x11
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0))]
    out += [_segment(0xDB, bytes([t]) + steps[t][ZIGZAG].astype(np.uint8).tobytes()) for t in range(min(2, len(planes)))]
    parts = b"".join(bytes([c + 1, wide if c == 0 else 0x11, min(c, 1)]) for c in range(len(planes)))
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + parts))
    for c, plane in enumerate(planes):
        rows, across = plane.shape
        padded = np.pad(plane, ((0, -rows % 8), (0, -across % 8)), "edge")
        tiles = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        blocks = np.rint((COSINES @ tiles @ COSINES.T).reshape(-1, 64) / steps[min(c, 1)]).astype(np.int64)[:, ZIGZAG]
        # a baseline value has ten bits, a difference of first values eleven
        out.append(_scan_bytes(np.clip(blocks, -1023, 1023), c + 1))
    return b"".join([*out, b"\xff\xd9"])
