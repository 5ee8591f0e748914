"""Removal of repeated byte strings by suffix arrays over the places that can hold one.

1. Every window of 200 bytes names an anchor: the gram of 64 bytes in it with the least hash. Equal windows name equal
   grams, so a window whose anchor's gram stands nowhere else is not repeated. Windows in a row with one anchor form a
   context; only contexts whose gram is repeated go on, each different one once, with its count.
2. The contexts that share a gram meet in one task, which builds their suffix array in two stages: suffixes smaller than
   their successors are sorted directly, all others are induced by scans over the buckets of first bytes. Neighbours in
   it with a common prefix of 200 bytes are repeats.
3. Repeated windows go back to all places of their contexts, and from there to the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, named, span_hashes, text_bytes, text_slices

LENGTH = 200
GRAM = 64
#: Bytes of contexts whose suffix array is built at once; a gram's contexts stay together.
CHUNK = 1 << 19
#: Windows whose anchors are found at once; their grams' places have to fit in 24 bits.
SLAB = 1 << 23
#: Ways to deal out the rows of grams that a task has already seen twice.
SALTS = 64


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, slab: int = SLAB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each context: the hash of its gram, its first window, and its number of windows."""
    windows = len(data) - length + 1
    if windows <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, least = np.empty(windows, np.uint64), np.empty(windows, np.int64)
    for a in range(0, windows, slab):
        b = min(windows, a + slab)
        hashes, at = window_anchors(data[a : b + length - 1], length, gram)
        grams[a:b], least[a:b] = hashes[at], at + a
    long = np.diff(offsets) >= length
    inside = np.zeros(len(data) + 1, np.int8)
    inside[offsets[:-1][long]] = 1
    inside[offsets[1:][long] - length + 1] -= 1
    inside = np.cumsum(inside[:windows], dtype=np.int8) > 0
    first = np.ones(windows, bool)
    first[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, windows))
    keep = inside[starts]
    return grams[starts[keep]], starts[keep], sizes[keep]


def window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and the place of each window's anchor. data is below 16 MB."""
    n, width = len(data), length - gram + 1
    at = np.arange(n - gram + 1)
    hashes = span_hashes(data, at, at + gram)
    ranked = np.full(-(-len(at) // width) * width, ~np.uint64(0))
    ranked[: len(at)] = hashes & ~np.uint64(0xFFFFFF) | at.astype(np.uint64)  # of equal ones the leftmost
    blocks = ranked.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    return hashes, (np.minimum(right[:windows], left[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of text, which ends with its only-smallest byte 0, in the order of their first depth bytes at least."""
    n = len(text)
    words = np.zeros(n + 8, np.uint64)
    words[:n] = text
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        words[: n + 8 - step] = words[: n + 8 - step] << np.uint64(shift) | words[step:]
    # the type of a suffix: whether the next different byte is greater
    change = np.flatnonzero(text[1:] != text[:-1])
    up = np.zeros(n, bool)
    up[-1] = True
    if len(change):
        after = np.searchsorted(change, np.arange(n - 1))
        known = after < len(change)
        at = change[after[known]]
        up[:-1][known] = text[at] < text[at + 1]
    small = np.flatnonzero(up)
    small = small[np.argsort(words[small], kind="stable")]
    refine(small, words, depth)
    # scan the buckets
    first = text[small]
    edges = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        parts, new = [], waiting[c]
        while new:
            batch = np.concatenate(new)
            parts.append(batch)
            before = batch[batch > 0] - 1
            new = [before[text[before] == c]] if len(before) else []
            new = [x for x in new if len(x)]
        parts.append(small[edges[c] : edges[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        heads = text[before]
        before, heads = before[heads > c], heads[heads > c]
        if len(before):
            order = np.argsort(heads, kind="stable")
            before, heads = before[order], heads[order]
            ends = np.append(np.flatnonzero(heads[1:] != heads[:-1]) + 1, len(heads))
            begin = 0
            for end in ends.tolist():
                waiting[heads[begin]].append(before[begin:end])
                begin = end
    return np.concatenate(out)


def refine(order: np.ndarray, words: np.ndarray, depth: int) -> None:
    """Sorts order, which is sorted by the first 8 bytes of its suffixes, by the first depth bytes, in place."""
    value = words[order]
    new = np.ones(len(order), bool)
    new[1:] = value[1:] != value[:-1]
    for at in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            return
        group = np.cumsum(new[where])
        some = order[where]
        value = words[np.minimum(some + at, len(words) - 1)]
        differ = (value[1:] != value[:-1]) & (group[1:] == group[:-1])
        if not differ.any():
            continue
        parted = np.zeros(group[-1] + 1, bool)  # groups that agree in these bytes stay as they are
        parted[group[1:][differ]] = True
        inside = parted[group]
        where, group, some, value = where[inside], group[inside], some[inside], value[inside]
        move = np.lexsort((value, group))
        some, value = some[move], value[move]
        order[where] = some
        new[where[1:]] |= (value[1:] != value[:-1]) & (group[1:] == group[:-1])


def common_prefixes(suffixes: np.ndarray, text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, counted up to depth in steps of 8 (first: 0)."""
    out = np.zeros(len(suffixes), np.int64)
    words = np.zeros(len(text) + depth + 8, np.uint64)
    words[: len(text)] = text
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        words[:-step] = words[:-step] << np.uint64(shift) | words[step:]
    live = np.arange(1, len(suffixes))
    for at in range(0, depth, 8):
        live = live[words[suffixes[live] + at] == words[suffixes[live - 1] + at]]
        out[live] = at + 8
    return out


def repeated_windows(contexts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(context, first window, windows) of each run of windows that stand in two places, in these contexts counted so often."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(c.replace(b"\0", b"\xf8") for c in contexts) + b"\0", np.uint8)  # UTF-8 has no byte F8
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    window = np.zeros(len(text) + 1, np.int32)
    window[starts] = 1
    window[starts + sizes - length + 1] -= 1
    window = np.cumsum(window[:-1]) > 0
    suffixes = suffix_array(text, length)
    suffixes = suffixes[window[suffixes]]
    same = common_prefixes(suffixes, text, length) >= length
    hit = same.copy()
    hit[:-1] |= same[1:]
    flag = np.zeros(len(text) + 1, bool)
    flag[suffixes[hit]] = True
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    flag[:-1] |= window & (counts > 1)[owner]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag])))
    return [(int(owner[a]), int(a - starts[owner[a]]), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


#: Anchors that a task compares with each other at once.
FLUSH = 1 << 21


def _anchor_rows(batches):
    grams, rows, held = [], [], 0
    for batch in batches:
        for part in text_slices(batch, 2):
            data, offsets = text_bytes(part.column(2))
            gram, start, size = anchors(data, offsets)
            row = np.searchsorted(offsets, start, side="right") - 1
            grams.append(gram.view(np.int64))
            rows.append((part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), (start - offsets[row]).astype(np.int32), size.astype(np.int32)))
            held += len(gram)
            if held >= FLUSH:
                yield from _salted(grams, rows)
                grams, rows, held = [], [], 0
    if rows:
        yield from _salted(grams, rows)


def _salted(grams, rows):
    """The anchors with a salt: what these have twice is known to be repeated, and only one row of it counts any further."""
    _, inverse, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    known = count[inverse] > 1
    first = np.zeros(len(known), bool)
    first[np.unique(inverse, return_index=True)[1]] = True
    salt = np.where(known & ~first, 1 + np.arange(len(known)) % SALTS, 0).astype(np.int32)
    at = 0
    for gram, (key, doc, start, size) in zip(grams, rows):
        part = slice(at, at + len(gram))
        at += len(gram)
        yield pa.RecordBatch.from_arrays([key, doc, pa.array(gram), pa.array(start), pa.array(size), pa.array(known[part]), pa.array(salt[part])], ["key", "doc_id", "gram", "start", "size", "known", "salt"])


def _context_rows(with_bytes: bool):
    """Contexts at the given anchors: all places (gram, context, key, doc_id, start), or each different one once with its count and bytes."""

    def run(batches):
        seen: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part in text_slices(batch, 2):
                data, offsets = text_bytes(part.column(2))
                lists = part.column(3)
                flat = lists.flatten()
                gram, start, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                first = offsets[row] + start
                last = first + size + LENGTH - 1
                context = span_hashes(data, first, last).view(np.int64)
                if with_bytes:
                    raw = data.tobytes()
                    for g, c, a, b in zip(gram.tolist(), context.tolist(), first.tolist(), last.tolist()):
                        if (g, c) in seen:
                            seen[g, c][0] += 1
                        else:
                            seen[g, c] = [1, raw[a:b]]
                    if len(seen) > 100_000:
                        yield _distinct(seen)
                        seen = {}
                else:
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(context), part.column(0).take(take), part.column(1).take(take), pa.array(start.astype(np.int64))], ["gram", "context", "key", "doc_id", "start"])
        if seen:
            yield _distinct(seen)

    return run


def _distinct(seen):
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in seen], pa.int64()), pa.array([c for _, c in seen], pa.int64()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([b for _, b in seen.values()], pa.binary())], ["gram", "context", "n", "bytes"])


def _repeats(batches):
    """From contexts sorted by gram: the runs of repeated windows, in chunks of whole grams."""
    chunk: dict[tuple[int, int], list] = {}
    size, last = 0, None
    for batch in batches:
        for g, c, n, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if g != last and size > CHUNK:
                yield from _chunk_runs(chunk)
                chunk, size = {}, 0
            last = g
            if (g, c) in chunk:
                chunk[g, c][0] += n
            else:
                chunk[g, c] = [n, raw]
                size += len(raw)
    if chunk:
        yield from _chunk_runs(chunk)


def _chunk_runs(chunk):
    keys = list(chunk)
    runs = repeated_windows([raw for _, raw in chunk.values()], np.array([n for n, _ in chunk.values()]))
    if runs:
        owner, first, size = zip(*runs)
        yield pa.RecordBatch.from_arrays([pa.array([keys[k][0] for k in owner]), pa.array([keys[k][1] for k in owner]), pa.array(first, pa.int64()), pa.array(size, pa.int64())], ["gram", "context", "first", "windows"])


def _removed(with_text: bool):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2):
                rows = []
                for value, spans in zip(part.column(2), part.column(3).to_pylist()):
                    raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                    kept, n_spans, at = [], 0, 0
                    for a, n in sorted((s["a"], s["n"]) for s in spans or ()):
                        if a > at or not n_spans:
                            kept.append(raw[at:a])
                            n_spans += 1
                        at = max(at, a + n - 1 + LENGTH)
                    kept = b"".join([*kept, raw[at:]])
                    rows.append((len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
                columns = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3 : 4 + with_text]]
                yield pa.RecordBatch.from_arrays([part.column(1), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(arrays)])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes each byte of a 200-byte string that starts in another place too, in the same or another document.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256[, kept (bytes that are no UTF-8 any
    more left out)]. Strings are judged on the whole input, and none crosses documents. A null text is empty; a null
    doc_id is kept; equal rows are two documents, each repeated in the other, and give equal rows; other columns are not
    read; an empty table gives no rows.
    """
    text = named(docs, id_col, text_col)
    # the key's last bit says that there is no id; all uses of text read the same columns, so its shuffle is done once
    key = F.expr("(xxhash64(doc_id, text) & -2) | cast(isnull(doc_id) as bigint)")
    text = text.select(key.alias("key"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    rows = text.mapInArrow(_anchor_rows, "key long, doc_id long, gram long, start int, size int, known boolean, salt int")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("gram", "salt"))).where("known or n > 1")
    found = cut(rows.groupBy("key", "doc_id").agg(F.collect_list(F.struct("gram", "start", "size")).alias("anchors")))
    places = text.join(found.hint("shuffle_hash"), ["key", "doc_id"]).select("key", "doc_id", "text", "anchors")
    contexts = places.mapInArrow(_context_rows(True), "gram long, context long, n long, bytes binary")
    runs = contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_repeats, "gram long, context long, first long, windows long")
    where = places.mapInArrow(_context_rows(False), "gram long, context long, key long, doc_id long, start long")
    hits = where.join(runs, ["gram", "context"]).select("key", "doc_id", F.struct((F.col("start") + F.col("first")).alias("a"), F.col("windows").alias("n")).alias("span"))
    spans = hits.groupBy("key", "doc_id").agg(F.collect_set("span").alias("spans"))
    out = text.join(spans.hint("shuffle_hash"), ["key", "doc_id"], "left").select("key", F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("doc_id")).alias("id"), "text", "spans")
    return out.mapInArrow(_removed(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
