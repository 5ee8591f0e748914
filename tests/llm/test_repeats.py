import hashlib
import random
from collections import Counter

import numpy as np

from framelake.llm import op07_suffix as op

from .fixtures import clashing, empty_docs, odd_docs, words


def brute(rows):
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(r[k : k + 200] for _, r in raws for k in range(len(r) - 199))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for k in range(len(r) - 199):
            if count[r[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone)[: len(r)] > 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    passage = words(rng, 300)
    extra = [words(rng, 50) + passage[a : a + n] + words(rng, 40) for a, n in ((0, 900), (100, 199), (100, 200), (300, 201), (0, 1200))]
    base = words(rng, 500)
    extra += [base, base[:700] + "X" + base[701:], "a" * 700, "ab" * 300 + "c", passage + "\0" + passage, "\0" * 450, "é" * 150, extra[0]]
    df, rows = odd_docs(spark, extra=extra)
    got = op.remove_repeats(clashing(df)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    assert op.remove_repeats(empty_docs(spark)).count() == 0


def test_ids_that_look_special(spark):
    text = "same text again and again " * 20
    rows = [(0, text), (None, text), (-(1 << 62), text), (None, None)]
    got = op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_row_over_16_mb(spark):
    big = np.random.default_rng(4).integers(97, 123, 17_500_000).astype(np.uint8).tobytes().decode()
    passage = big[17_000_000:17_000_600]
    rows = [(1, big), (2, "A" + passage + "B"), (3, big[16_777_100:16_777_500])]
    got = op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(1, 17_500_000, 1000, 2), (2, 602, 600, 1), (3, 400, 400, 1)]


def test_anchors_do_not_depend_on_slabs():
    rng = np.random.default_rng(6)
    data, offsets = rng.integers(97, 99, 5000).astype(np.uint8), np.array([0, 900, 1000, 4000, 5000])
    whole = op.anchors(data, offsets)
    assert all((a == b).all() for slab in (1, 137, 1000) for a, b in zip(op.anchors(data, offsets, slab=slab), whole, strict=True))


def test_suffix_array():
    rng = np.random.default_rng(2)
    for size, letters in ((1, 1), (50, 1), (400, 2), (3000, 3), (3000, 26)):
        text = np.append(rng.integers(1, letters + 1, size), 0).astype(np.uint8)
        raw = text.tobytes()
        assert op.suffix_array(text, len(text)).tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
