"""Near-duplicate documents by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

1. Documents with equal shingle sets form a class; only its least document goes on.
2. A set's hashes fall into 128 bins, whose minima are its signature; an empty bin borrows from the bin that a hash of
   its number and of the attempt names. 32 bands of 4 minima make the buckets: a pair at similarity 0.75 meets in none
   of them with a probability of 5e-6.
3. Each member of a bucket is a candidate for the bucket's least member only, and is confirmed on full sets.
4. A star can miss a link between two members that are both unlike the hub. So what the confirmed links leave in one
   bucket but in different components meets there once more, with texts: sizes and signatures rule most pairs out, full
   sets confirm the others until one link joins two components, and no pair is written down but such links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, cut, documents, gram_hashes, mix64, named, span_hashes, text_bytes, text_slices, word_spans
from .graph import components

WIDTH = 5
#: The least similarity, as intersection over union.
SHARE = (75, 100)
BINS, ROWS = 128, 4
#: Bins in which two signatures must agree to be confirmed in step 4; a similarity of 0.75 gives 96, with a deviation of
#: 4.9, so 5.7 deviations lie between. Sets of fewer than TINY shingles, whose bins borrow much, are always confirmed.
AGREE, TINY = 68, 16
ATTEMPTS = 4096
#: Members of a bucket that are compared at once in step 4.
BLOCK = 1024


def probes() -> np.ndarray:
    """probes()[attempt, bin]: the bin that an empty bin asks at an attempt."""
    x = np.arange(ATTEMPTS * BINS, dtype=np.uint64) + np.uint64(12345)
    return (mix64(x) >> np.uint64(40)).astype(np.int64).reshape(ATTEMPTS, BINS) % BINS


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each bin's least hash, after densification; a row for each set, none empty."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    first = np.stack([np.searchsorted(s, edges) for s in sets])
    sizes = np.array([len(s) for s in sets])
    full = np.concatenate([first[:, 1:], sizes[:, None]], 1) > first
    at = np.minimum(first, sizes[:, None] - 1) + (np.cumsum(sizes) - sizes)[:, None]
    out = (mix64(np.concatenate(sets))[at] & np.uint64(0xFFFF)).astype(np.uint16)
    table = probes()
    row, bin_ = np.nonzero(~full)
    for attempt in range(ATTEMPTS):
        if not len(row):
            break
        lender = table[attempt, bin_]
        hit = full[row, lender]
        out[row[hit], bin_[hit]] = out[row[hit], lender[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    if len(row):  # a set of very few shingles: the next full bin
        for r, b in zip(row.tolist(), bin_.tolist()):
            out[r, b] = out[r, (b + 1 + np.flatnonzero(np.roll(full[r], -b - 1))[0]) % BINS]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A bucket for each band: its minima, mixed with its number."""
    bands = signature.view(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(bands + np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _profiles(batches):
    for batch in batches:
        for part in text_slices(batch, 1):
            sets = shingle_sets(part.column(1))
            some = [s for s in sets if len(s)]
            found = iter(signatures(some)) if some else iter(())
            signature = [next(found).tobytes() if len(s) else None for s in sets]
            digest = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (None, None) for s in sets]
            columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()), pa.array(signature, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "signature"])


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BINS)
            keys = band_keys(signature)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], ["bucket", "id"])


def _confirm(batches):
    """Of pairs with both texts, those whose full sets are similar enough."""
    for batch in batches:
        for part in text_slices(batch, 2):
            left = shingle_sets(part.column(2))
            right = shingle_sets(part.column(3))
            keep = []
            for a, b in zip(left, right):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both))
            if any(keep):
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])


def confirm(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts are near-duplicates."""
    left = text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def _strays(batches):
    """From bucket members sorted by bucket, with texts: links that join different components, confirmed on full sets.

    A pair is looked at in the first band only that both share, and only until something joins its components.
    """
    bucket, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if row[0] != bucket:
                yield from _bucket_links(rows)
                bucket, rows = row[0], []
            rows.append(row)
    yield from _bucket_links(rows)


def _bucket_links(rows: list[tuple]):
    if len(rows) < 2:
        return
    rows.sort(key=lambda r: r[3])
    ids, part, size = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
    signature = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, BINS)
    band = int((band_keys(signature[:1])[0] == rows[0][0]).argmax())
    sets = shingle_sets(pa.array([r[5] for r in rows], pa.string()))
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    places = np.split(number, np.cumsum([len(s) for s in sets])[:-1])
    mark = np.zeros(int(number.max()) + 1, np.int64)
    parts, counts = np.unique(part, return_counts=True)
    most = parts[counts.argmax()]
    found = []
    for at in np.flatnonzero(part != most).tolist():
        # the rows are in order of size, so a partner is near
        first = int(np.searchsorted(size, -(-size[at] * SHARE[0] // SHARE[1]), side="left"))
        end = int(np.searchsorted(size, size[at] * SHARE[1] // SHARE[0], side="right"))
        mark[places[at]] = 1
        for low in range(first, end, BLOCK):
            rest = slice(low, min(end, low + BLOCK))
            same = signature[rest] == signature[at]
            maybe = (part[rest] != part[at]) & ((same.sum(1) >= AGREE) | (size[rest] < TINY))
            maybe &= same.reshape(len(same), -1, ROWS).all(2).argmax(1) == band
            some = low + np.flatnonzero(maybe)
            if len(some):
                edge = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                both = np.add.reduceat(mark[np.concatenate([places[j] for j in some])], edge)
                for j in some[SHARE[1] * both >= SHARE[0] * (size[some] + size[at] - both)].tolist():
                    if part[j] != part[at]:
                        found.append((max(ids[j], ids[at]), min(ids[j], ids[at])))
                        part[part == part[j]] = part[at]
        mark[places[at]] = 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id).

    Shingles are 5 words in a row (fewer words: all of them), words are runs without ASCII white space, A-Z in lower
    case. Documents are linked at an intersection of at least 75 % of the union. A document without words, or with a
    null text, is linked with nothing. A row with a null doc_id takes no part: its component is null and it is kept.
    Rows of one doc_id are judged apart but share a component_id if their texts are linked; equal rows give equal rows.
    Other columns are not read; an empty table gives no rows.
    """
    docs = named(docs, id_col, text_col)
    nameless = docs.where("doc_id is null").mapInArrow(_profiles, PROFILE)
    nameless = nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    docs = docs.where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = docs.select(F.col("doc_id").alias("real"), F.xxhash64("doc_id", "text").alias("doc_id"), "text")
        rows = rows.drop("text").join(_linked(rows.select("doc_id", "text")).distinct(), "doc_id")
        least = rows.groupBy(F.col("component_id").alias("c")).agg(F.min("real").alias("component"))
        rows = rows.join(least, F.col("component_id") == F.col("c"))
        out = rows.select(F.col("real").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    else:
        out = _linked(docs)
    out = out.unionAll(nameless)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


PROFILE = "doc_id long, n long, s1 long, s2 long, signature binary"


def _linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for documents with ids, where rows of one id are equal."""
    profiles = cut(docs.mapInArrow(_profiles, PROFILE))
    classes = profiles.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "signature")).alias("r"))
    heads = cut(classes.select("s1", "s2", F.col("r.doc_id").alias("id"), F.col("r.n").alias("n"), F.col("r.signature").alias("signature")))
    members = heads.select("id", "signature").mapInArrow(_bands, "bucket long, id long")
    hubs = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "hub")
    members = cut(members.join(hubs, "bucket"))
    stars = members.where("id <> hub").groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    text = cut(docs.join(members.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi").distinct())
    links = cut(confirm(stars, text))
    marked = members.join(components(links), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("part"))
    open_ = marked.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("bucket")
    rest = marked.join(open_, "bucket").join(heads.select("id", "n", "signature"), "id").join(text.withColumnRenamed("doc_id", "id"), "id")
    rest = rest.select("bucket", "id", "part", "n", "signature", "text").repartition("bucket").sortWithinPartitions("bucket")
    links = links.unionAll(cut(rest.mapInArrow(_strays, "a long, b long")))
    found = components(links)
    heads = heads.join(found, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component"))
    out = profiles.join(heads, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
