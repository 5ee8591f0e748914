import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from framelake.llm import op01_license, op02_packing, op05_wavelet, op10_mpeg

from .fixtures import clashing, empty_docs, odd_docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_id(rows):
    return sorted(map(repr, rows))


def test_licences_against_brute_force(spark):
    extra = ["Under the MIT license, and under the mit-license. under the MIT licenses", "Apache License, Version 2.0 CC BY-NC cc by nc", op01_license.TEMPLATES["isc"][0].upper(), "under the mit"]
    df, rows = odd_docs(spark, extra=extra)
    got = op01_license.licences(clashing(df)).collect()
    want = []
    for i, text, *_ in rows:
        w = WORD.findall(lower(text))
        starts, labels = [], set()
        for phrase, label in op01_license.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += hits
            labels |= {label} if hits else set()
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    assert by_id(tuple(r)[:6] for r in got) == by_id(want)
    assert any("isc" in r.labels for r in got) and all(0 <= r.score <= 1 for r in got)
    assert op01_license.licences(empty_docs(spark)).count() == 0


def test_licence_template_needs_its_key_phrase():
    index = op01_license.default_index()
    text, keys = op01_license.TEMPLATES["isc"]
    assert "isc" in index.scan(text.encode().split())[1]
    assert "isc" not in index.scan(text.replace("with or without fee", "with no fee").encode().split())[1]


def test_templates_against_brute_force():
    rng = random.Random(3)
    filler = ["lorem", "the", "software", "of", "and", "license", "copy"]
    index = op01_license.default_index()

    def in_order(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + (x == y), row[j + 1], new[j]))
            row = new
        return row[-1]

    def brute(words):
        out = {}
        text = " " + " ".join(words) + " "
        for label, (template, must) in op01_license.TEMPLATES.items():
            t = template.split()
            if not all(f" {k} " in text for k in must):
                continue
            for at in range(-len(t), len(words)):
                part = words[max(0, at - 4) : max(0, at + len(t) + 4)]
                if all(f" {k} " in f" {' '.join(part)} " for k in must):
                    share = in_order(t, part) / len(t)
                    if share >= 0.7:
                        out[label] = max(out.get(label, 0), share)
        return out

    seen = set()
    for label, (template, must) in op01_license.TEMPLATES.items():
        for rate in (0.0, 0.1, 0.25, 0.4):
            words = ["zz" if rng.random() < rate else w for w in template.split()]
            for key in must if rng.random() < 0.8 else ():
                at = template.split().index(key.split()[0])
                at = next(k for k in range(at, len(words)) if template.split()[k : k + len(key.split())] == key.split())
                words[at : at + len(key.split())] = key.split()
            words = [rng.choice(filler) for _ in range(20)] + words + [rng.choice(filler) for _ in range(20)]
            want = brute(words)
            got = index.scan([w.encode() for w in words])[1]
            assert {k: v for k, v in got.items() if k in op01_license.TEMPLATES and k not in op01_license.PHRASES.values()}.keys() == {k for k in want if k not in op01_license.PHRASES.values()}, (label, rate)
            assert all(v - 0.1 <= got[k] <= v + 1e-12 for k, v in want.items() if k not in op01_license.PHRASES.values())
            seen |= set(want)
    assert seen == set(op01_license.TEMPLATES)


BSD = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
   disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """
3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
"""


def test_verbatim_bsd_licences():
    def labels(text):
        return set(op01_license.default_index().scan(lower(text).encode().translate(op01_license.TO_WORDS).split())[1])

    two, three = BSD.format(""), BSD.format(THIRD.format("the copyright holder"))
    assert labels(two) == {"bsd-2-clause"} and labels(three) == {"bsd-3-clause"}
    assert labels(BSD.format(THIRD.format("the Pallets project team and its many friends"))) == {"bsd-3-clause"}
    assert labels("x " * 99 + two + "y " * 500 + three) == {"bsd-2-clause", "bsd-3-clause"}
    assert labels(two.replace("Redistributions", "Copies").replace("Redistribution and", "The")) == set()
    head, tail = two.split("1. Redistributions")
    assert labels(head + "other words " * 40 + "1. Redistributions" + tail) == set()


def tokens(path, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_packing(spark):
    df, rows = odd_docs(spark)
    path = op02_packing.vocabulary("word_bpe_49k.json")
    got = op02_packing.pack(clashing(df), group=20, with_ids=True).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == crc(r.ids) and len(r.ids) == r.length
    for parts in seqs.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert sum(p.length for p in parts) <= 2048
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
    texts = {r[0]: r[1] for r in rows}
    for i, parts in docs.items():
        want = tokens(path, texts[i], 1)
        assert all(p.ids == want[p.start : p.start + p.length] and p.doc_tokens == len(want) for p in parts)
        assert sorted({p.start for p in parts}) == list(range(0, len(want), 2048))
    assert len(docs) == len(texts)
    assert sum(r.length for r in got) > 0.7 * 2048 * len(seqs)
    assert op02_packing.pack(empty_docs(spark)).count() == 0


def test_first_fit_decreasing():
    import numpy as np

    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 500)
    bins, offsets = op02_packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for k in np.argsort(-lengths, kind="stable"):
        at = next((b for b, r in enumerate(room) if r >= lengths[k]), None)
        if at is None:
            at = len(room)
            room.append(100)
        room[at] -= lengths[k]
        want[k] = at
    assert [want[k] for k in range(500)] == bins.tolist()


def test_token_shards(spark, tmp_path):
    df, rows = odd_docs(spark)
    path = op02_packing.vocabulary("byte_bpe_50k.json")
    shards = op05_wavelet.write_shards(clashing(df), f"file://{tmp_path}/shards", shard_ids=9000).collect()
    assert len({r.path for r in shards}) == len({r.shard for r in shards}) == len(shards)
    got = op05_wavelet.read_shards(spark.createDataFrame(shards), with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    start, want = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokens(path, text, 2)
        want.append((i, start, len(ids), crc(ids), ids))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    largest = max(shards, key=lambda r: r.n_tokens)
    matrix, doc_ids, ends = op05_wavelet.open_shard(op05_wavelet.open_file(largest.path))
    ids = matrix.decode().tolist()
    assert ends[-1] == len(ids)
    for value in {ids[0], ids[-1], 2, 50256}:
        places = [k for k, x in enumerate(ids) if x == value]
        assert matrix.occurrences(value) == places and matrix.rank(value, 700) == sum(p < 700 for p in places)
    assert [matrix.access(k) for k in range(0, len(ids), 97)] == ids[::97]
    many = np.random.default_rng(3).integers(0, 50257, 3 * op05_wavelet.BLOCK + 11)
    data, loaded = op05_wavelet.WaveletMatrix.build(many).to_bytes([1], np.array([len(many)])), []
    matrix = op05_wavelet.open_shard(data)[0]
    load = matrix._load
    matrix._load = lambda *block: loaded.append(block) or load(*block)
    assert matrix.access(40_000) == many[40_000] and len(loaded) <= 2 * matrix.depth
    assert (matrix.decode() == many).all() and matrix.occurrences(int(many[7])) == np.flatnonzero(many == many[7]).tolist()
    with pytest.raises(IndexError):
        matrix.access(len(many))
    empty = op05_wavelet.write_shards(empty_docs(spark), f"file://{tmp_path}/none")
    assert op05_wavelet.read_shards(empty).count() == 0


def test_mpeg(spark):
    df, rows = odd_docs(spark)
    got = op10_mpeg.media(clashing(df), with_media=True).collect()
    want = []
    for i, text, *_ in rows:
        raw = (text or "").encode()
        pay = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    assert by_id(tuple(r)[:5] for r in got) == by_id(want)
    assert all(r.media_sha256 == hashlib.sha256(r.media).hexdigest() and "bad_crc=0;skipped=0" in r.feature for r in got)
    assert op10_mpeg.media(empty_docs(spark)).count() == 0


def test_mpeg_resynchronises_and_checks():
    payload = bytes(range(256)) * 40
    data = bytearray(op10_mpeg.write_stream(payload, len(payload)))
    back = op10_mpeg.read_stream(bytes(data))
    assert back["payload"] == payload and back["vbr"]["frames"] == back["frames"] and back["bad_crc"] == 0
    assert back["duration_s"] == back["frames"] * 1152 / 48000
    at = op10_mpeg.seek_offset(op10_mpeg.read_stream(bytes(data), seek_every=2)["seek"], 1152 * 3)
    assert op10_mpeg.parse_header(bytes(data), at)
    second = back["seek"][0][1]
    noisy = bytes(data[:second]) + b"junk\xff\xffjunk" + bytes(data[second:])
    again = op10_mpeg.read_stream(noisy + b"TAG" + bytes(125))
    assert again["payload"] == payload and again["skipped"] == 10
    data[second + 5] ^= 1
    assert op10_mpeg.read_stream(bytes(data))["bad_crc"] == 1
    toc = back["vbr"]["toc"]
    assert len(toc) == 100 and all(abs(op10_mpeg.table_offset(back, k / 100) - (back["vbr_at"] + toc[k][1])) == 0 for k in range(100))


def bit_crc(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


def layer_frame(layer, mode=3):
    """A protected MPEG-1 frame of layer I or II at 48 kHz with random bytes; its checksum by hand."""
    rng = random.Random(layer)
    index = 5
    header = bytes([0xFF, 0xF8 | (4 - layer) << 1, index << 4 | 1 << 2, mode << 6])
    size = op10_mpeg.parse_header(header, 0)[0]
    body = bytes(rng.randrange(1, 255) for _ in range(size - 6))
    bits = [b >> k & 1 for b in body for k in range(7, -1, -1)]
    if layer == 1:
        covered = 4 * 32 * (1 if mode == 3 else 2)
    else:  # 80 kbit/s mono: 27 subbands
        at = used = 0
        for n, width in ((11, 4), (12, 3), (4, 2)):
            for _ in range(n):
                used += any(bits[at : at + width])
                at += width
        covered = at + 2 * used
    head = [b >> k & 1 for b in header[2:] for k in range(7, -1, -1)]
    return header + bit_crc(head + bits[:covered]).to_bytes(2, "big") + body


def test_mpeg_layers_tables_tags_and_rates(spark):
    one, two = layer_frame(1, mode=0), layer_frame(2)
    for good in (one, two):
        bad = bytearray(good * 3)
        bad[6] ^= 0x10
        assert op10_mpeg.read_stream(good * 3)["bad_crc"] == 0 and op10_mpeg.read_stream(bytes(bad))["bad_crc"] == 1
    plain = lambda hz_index: bytes([0xFF, 0xFB, 9 << 4 | hz_index << 2, 0xC0])
    frame = lambda k: plain(k).ljust(op10_mpeg.parse_header(plain(k), 0)[0], b"\1")
    mixed = op10_mpeg.read_stream(frame(0) * 3 + frame(1) * 2 + frame(2))
    assert mixed["rates"] == {44100: 3456, 48000: 2304, 32000: 1152} and mixed["duration_s"] == pytest.approx(3456 / 44100 + 2304 / 48000 + 1152 / 32000, abs=1e-15)
    vbri = bytearray(frame(1))
    vbri[36:] = (b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + (4 * len(frame(1))).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes([0, 2, 0, 2, 0, 2, 0, 2]) + len(frame(1)).to_bytes(2, "big") * 2).ljust(len(vbri) - 36, b"\0")
    back = op10_mpeg.read_stream(bytes(vbri) + frame(1) * 4)
    assert back["vbr"]["kind"] == "VBRI" and back["vbr"]["frames"] == back["frames"] == 4
    assert op10_mpeg.table_offset(back, 0.5) == 3 * len(frame(1)) and op10_mpeg.table_offset(back, 0.0) == len(frame(1))
    text = b"TIT2" + bytes([0, 0, 0, 6, 0, 0]) + b"\3Song\0" + b"TXXX" + bytes([0, 0, 0, 6, 0, 0]) + b"\0a\0b\0c"
    old = b"TAG" + b"Old title".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(30) + b"1999" + bytes(28) + bytes([0, 7, 12])
    tagged = b"ID3\4\0\0" + op10_mpeg.syncsafe(len(text)) + text + frame(1) * 2 + old
    assert op10_mpeg.read_stream(tagged)["tags"] == {"TIT2": "Song", "a": "b", "title": "Old title", "artist": "Band", "year": "1999", "track": "7"}
    rows = [(1, tagged, "x"), (2, None, "x"), (3, b"", "x"), (3, b"", "x"), (4, b"no frames here \xff\xfb", "x"), (None, frame(0) * 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, mpeg string")
    got = {(r.doc_id, r.media and bytes(r.media)): r.mpeg for r in op10_mpeg.probe(df).collect()}
    assert got[2, None] is None and got[3, b""].frames == 0 and got[4, rows[4][1]].frames == 0
    assert got[1, tagged].frames == 2 and got[1, tagged].tags["artist"] == "Band" and got[None, frame(0) * 3].rates == {44100: 3456}
    assert op10_mpeg.probe(df).count() == 6 and op10_mpeg.probe(df.limit(0)).count() == 0
