"""MPEG audio as a media column: frame writing, resynchronising frame reading, tags, variable-bitrate tables, checksums, seeks.

Streams are MPEG-1 layer III, mono, 48 kHz, each frame with a checksum. A frame has silent granules and carries its
share of a payload as ancillary data, which the format lets any frame hold behind its main data.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, named, text_slices

#: Fixed values of the format: kbit/s by header index for MPEG-1 layers I, II, III and MPEG-2/2.5 layers I and II/III; Hz; samples a frame.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

UNIT = 64
RATE = 48_000
SIDE = 17
HEAD = 4 + 2 + SIDE
SIZES = [3 * k for k in KBPS[1, 3]]
ROOM = SIZES[-1] - HEAD


def crc16(data: bytes) -> int:
    """The checksum of a protected frame: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def frame_head(index: int) -> bytes:
    """Sync, MPEG-1 layer III with checksum, bitrate index, 48 kHz, mono; its checksum; empty side information."""
    header = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    return header + struct.pack(">H", crc16(header[2:] + bytes(SIDE))) + bytes(SIDE)


HEADS = [frame_head(k) if k else b"" for k in range(15)]


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes, unpadded: int) -> bytes:
    """An ID3v2 tag with the payload's sizes, a frame with a Xing table, and frames that carry the payload."""
    whole, rest = divmod(len(payload), ROOM)
    sizes = [SIZES[-1]] * whole
    if rest:
        index = next(k for k in range(1, 15) if SIZES[k] - HEAD >= rest)
        sizes.append(SIZES[index])
    body = np.empty((whole, SIZES[-1]), np.uint8)
    body[:, :HEAD] = np.frombuffer(HEADS[14], np.uint8)
    body[:, HEAD:] = np.frombuffer(payload, np.uint8, whole * ROOM).reshape(whole, ROOM)
    parts = [body.tobytes()]
    if rest:
        parts.append((HEADS[index] + payload[whole * ROOM :]).ljust(SIZES[index], b"\0"))
    text = f"payload_bytes\0{len(payload)}\0unpadded_bytes\0{unpadded}".encode("latin-1")
    frames = b"TXXX" + struct.pack(">IH", len(text) + 1, 0) + b"\0" + text
    tag = b"ID3\x03\x00\x00" + syncsafe(len(frames)) + frames
    first = next(k for k in range(1, 15) if SIZES[k] >= HEAD + 120)
    total = SIZES[first] + sum(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    toc = bytes(min(255, int(256 * (SIZES[first] + ends[min(len(sizes), k * len(sizes) // 100)]) // total)) for k in range(100))
    xing = HEADS[first] + b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc
    return tag + xing.ljust(SIZES[first], b"\0") + b"".join(parts)


def parse_header(data: bytes, at: int) -> tuple[int, int, int, int, bool, int] | None:
    """Size in bytes, samples, Hz, channels, protected and side-information bytes of the frame whose header stands at at."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    index, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    family = 1 if version == 3 else 2
    kbps, hz = KBPS[family, layer if family == 1 else min(layer, 2)][index], HZ[version][rate]
    samples, padding = SAMPLES[family, layer], data[at + 2] >> 1 & 1
    size = (12 * kbps * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + padding
    channels = 1 if data[at + 3] >> 6 == 3 else 2
    side = {(1, 1): 17, (1, 2): 32, (2, 1): 9, (2, 2): 17}[family, channels] if layer == 3 else 0
    return size, samples, hz, channels, not data[at + 1] & 1, side


#: Fixed values of the format: bits of a subband's allocation in layer II, by table, as (subbands, bits) runs.
ALLOCATION = {"a": [(11, 4), (12, 3), (4, 2)], "b": [(11, 4), (12, 3), (7, 2)], "c": [(2, 4), (6, 3)], "d": [(2, 4), (10, 3)], "lsf": [(4, 4), (7, 3), (19, 2)]}


def allocation_bits(version: int, kbps: int, hz: int, channels: int) -> list[int]:
    """Layer II: the allocation bits of each subband."""
    each = kbps // channels
    if version != 3:
        table = "lsf"
    elif each <= 48:
        table = "d" if hz == 32000 else "c"
    else:
        table = "a" if each <= 80 or hz == 48000 else "b"
    return [bits for n, bits in ALLOCATION[table] for _ in range(n)]


def protected_bits(frame: bytes) -> int:
    """Bits behind the checksum of a layer I or II frame that it covers: allocations and, in layer II, their selectors."""
    version, layer = frame[1] >> 3 & 3, 4 - (frame[1] >> 1 & 3)
    mode = frame[3] >> 6
    channels = 1 if mode == 3 else 2
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * (channels * min(bound, 32) + 32 - min(bound, 32))
    family = 1 if version == 3 else 2
    kbps, hz = KBPS[family, 2][frame[2] >> 4], HZ[version][frame[2] >> 2 & 3]
    bits, at, used = allocation_bits(version, kbps, hz, channels), 0, 0
    body = int.from_bytes(frame[6:], "big")
    size = 8 * (len(frame) - 6)
    for band, n in enumerate(bits):
        for _ in range(channels if band < bound else 1):
            used += (channels if band >= bound else 1) * bool(at + n <= size and body >> (size - at - n) & ((1 << n) - 1))
            at += n
    return min(size, at + 2 * used)


def crc16_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    """crc16 of the first bits of data."""
    for k in range(bits):
        top = (crc >> 15) ^ (data[k >> 3] >> (7 - (k & 7)) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def read_id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of versions 2.2 to 2.4 by name (TXXX by its description) and where the tag ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    version, end, at, tags = data[3], min(len(data), 10 + safe(data[6:10])), 10, {}
    if data[5] & 0x40 and version >= 3:  # an extended header
        at += safe(data[10:14]) if version == 4 else 4 + int.from_bytes(data[10:14], "big")
    head = 6 if version == 2 else 10
    while at + head <= end and data[at : at + 1].isalnum():
        if version == 2:
            name, size = data[at : at + 3], int.from_bytes(data[at + 3 : at + 6], "big")
        else:
            name, size = data[at : at + 4], safe(data[at + 4 : at + 8]) if version == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + head : min(end, at + head + size)]
        if name[:1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            words = text.split("\0")
            if name in (b"TXXX", b"TXX"):
                tags |= dict(zip(words[::2], words[1::2]))
            else:
                tags[name.decode("latin-1")] = words[0]
        at += head + size
    return tags, end + (10 if version == 4 and data[5] & 0x10 else 0)


def read_id3v1(data: bytes) -> dict[str, str]:
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return {}
    tag = data[-128:]
    places = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    tags = {k: tag[a:b].split(b"\0")[0].decode("latin-1").strip() for k, (a, b) in places.items()}
    if tag[125] == 0 and tag[126]:
        tags["track"] = str(tag[126])
    return {k: v for k, v in tags.items() if v}


def read_table(data: bytes, at: int, size: int, side: int) -> dict | None:
    """The variable-bitrate table of the frame at at: kind, frames, bytes, toc ([share of the duration, byte offset from the frame])."""
    body = data[at + 4 : at + size]
    for start in (side, side + 2):  # with and without a checksum
        if body[start : start + 4] in (b"Xing", b"Info"):
            flags, k = int.from_bytes(body[start + 4 : start + 8], "big"), start + 8
            out = {"kind": body[start : start + 4].decode(), "frames": None, "bytes": None, "toc": []}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(body[k : k + 4], "big")
                    k += 4
            if flags & 4 and out["bytes"]:
                out["toc"] = [[j / 100, b * out["bytes"] // 256] for j, b in enumerate(body[k : k + 100])]
            return out
    if body[32:36] == b"VBRI" and len(body) >= 58:
        _, _, _, total, frames, entries, scale, width, _ = struct.unpack(">HHHIIHHHH", body[36:58])
        offset, toc = size, [[0.0, size]]
        for j in range(entries):
            offset += scale * int.from_bytes(body[58 + width * j : 58 + width * (j + 1)], "big")
            toc.append([(j + 1) / entries, offset])
        return {"kind": "VBRI", "frames": frames, "bytes": total, "toc": toc}
    return None


def read_stream(data: bytes, seek_every: int = 64) -> dict:
    """Reads a stream back, whatever stands between its frames.

    A header counts if another frame, a tag or the end follows its frame; else reading goes on with the next byte that
    may begin one. Returns tags, the variable-bitrate table (or None) and where it stands, frames, samples, hz (of the
    last frame), rates (samples by hz), duration_s (the sum of samples/hz over the rates), bad_crc, skipped bytes, seek
    ([sample, byte offset] every seek_every frames), payload (bytes behind the side information).
    """
    tags, at = read_id3v2(data)
    out = {"tags": tags | {k: v for k, v in read_id3v1(data).items() if k not in tags}, "vbr": None, "vbr_at": None, "frames": 0, "samples": 0, "hz": 0, "rates": {}, "bad_crc": 0, "skipped": 0, "seek": [], "payload": b""}
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    seen: dict[bytes, tuple | None] = {}
    crcs: dict[bytes, bool] = {}
    parts, first, last_end = [], True, at
    while at + 4 <= end:
        key = data[at : at + 4]
        if key not in seen:
            seen[key] = parse_header(data, at)
        head = seen[key]
        if head is None or head[0] < 4 or at + head[0] > end or not (at + head[0] == end or data[at + head[0]] == 0xFF or at == last_end):
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out["skipped"] += step - at
            at = step
            continue
        size, samples, hz, _, protected, side = head
        body = at + 4 + 2 * protected + side
        if protected:
            if side:
                covered = data[at + 2 : body]
                if covered not in crcs:
                    crcs[covered] = crc16(covered[:2] + covered[4:]) == int.from_bytes(covered[2:4], "big")
                good = crcs[covered]
            else:
                frame = data[at : at + size]
                good = crc16_bits(frame[6:], protected_bits(frame), crc16(frame[2:4])) == int.from_bytes(frame[4:6], "big")
            out["bad_crc"] += not good
        table = read_table(data, at, size, side) if first else None
        if table:
            out["vbr"], out["vbr_at"] = table, at
        else:
            if out["frames"] % seek_every == 0:
                out["seek"].append([out["samples"], at])
            out["frames"] += 1
            out["samples"] += samples
            out["hz"] = hz
            out["rates"][hz] = out["rates"].get(hz, 0) + samples
            parts.append(data[body : at + size])
        first, at = False, at + size
        last_end = at
    out["skipped"] += max(0, end - at)
    payload = b"".join(parts)
    stored = out["tags"].get("payload_bytes", "")
    out["payload"] = payload[: int(stored)] if stored.isdigit() else payload
    out["duration_s"] = float(sum(Fraction(n, hz) for hz, n in out["rates"].items()))
    return out


def seek_offset(seek: list[list[int]], sample: int) -> int:
    """The byte offset of the last indexed frame that starts at sample or before it."""
    return seek[max(0, bisect.bisect_right(seek, [sample, 1 << 62]) - 1)][1]


def table_offset(stream: dict, share: float) -> int | None:
    """The byte offset to which the stream's own table sends a reader who wants this share of the duration."""
    if not stream["vbr"] or not stream["vbr"]["toc"]:
        return None
    toc = stream["vbr"]["toc"]
    return stream["vbr_at"] + toc[max(0, bisect.bisect_right(toc, [share, 1 << 62]) - 1)][1]


PROBE = "frames long, samples long, duration_s double, rates map<int,long>, bad_crc long, skipped long, table string, table_frames long, tags map<string,string>, seek array<struct<sample:long,offset:long>>"


def probe(streams: DataFrame, media_col: str = "media", seek_every: int = 64) -> DataFrame:
    """streams, all rows and columns, with a struct column mpeg of what read_stream() finds in the bytes of media_col.

    Streams may be of any MPEG audio version and layer, with several sampling rates, tags and noise. Null bytes give a
    null struct, empty ones or such without a frame one with no frames; a column mpeg that is there is replaced; repeated
    rows each give a row; an empty table gives no rows.
    """

    @F.pandas_udf(T.StructType.fromDDL(PROBE))
    def look(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            s = read_stream(bytes(value), seek_every) if value is not None else None
            rows.append([None] * 10 if s is None else [s["frames"], s["samples"], s["duration_s"], s["rates"], s["bad_crc"], s["skipped"], s["vbr"]["kind"] if s["vbr"] else None, s["vbr"]["frames"] if s["vbr"] else None, s["tags"], [{"sample": a, "offset": b} for a, b in s["seek"]]])
        return pd.DataFrame(rows, columns=[f.split()[0] for f in PROBE.split(", ")])

    return streams.withColumn("mpeg", F.when(F.col(media_col).isNotNull(), look(F.col(media_col))))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, with_media: bool = False) -> DataFrame:
    """Stores each text as an MPEG audio stream and reads it back.

    The payload is the text's UTF-8 with bytes 0 up to a positive multiple of unit; a null or empty text is unit zeros.
    A null doc_id is kept, repeated rows each give a row, other columns are not read, an empty table gives no rows.
    feature: frames, exact duration, checksum failures, skipped bytes, seek points, offsets of the middle by the frames
    and by the stream's own table. with_media adds the stream itself.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = []
                for value in part.column(1):
                    raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                    size = max(unit, -(-len(raw) // unit) * unit)
                    stored = write_stream(raw.ljust(size, b"\0"), len(raw))
                    back = read_stream(stored)
                    got = back["payload"]
                    seek = back["seek"]
                    feature = f"frames={back['frames']};samples={back['samples']};hz={back['hz']};duration_s={back['duration_s']:.6f};bad_crc={back['bad_crc']};skipped={back['skipped']};vbr_frames={back['vbr']['frames']};seeks={len(seek)};mid_offset={seek_offset(seek, back['samples'] // 2)};table_mid={table_offset(back, 0.5)}"
                    rows.append((int(back["tags"]["unpadded_bytes"]), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, stored if with_media else None))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_media
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return named(docs, id_col, text_col).mapInArrow(run, schema)


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(documents(spark, sf_dir))
