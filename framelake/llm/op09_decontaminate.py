"""Benchmark decontamination by spaced seeds: hashes of words under fixed masks, joined and verified around the hits."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, cut, documents, mix64, named, span_hashes, text_bytes, text_slices, word_spans

#: 1: the word counts, 0: it may differ. Each overlap that the rule below accepts holds a seed: no start or end of a best
#: run has half as many differences as matches, and the masks meet all such runs of up to 15 words and all starts of 16.
MASKS = ("11101100101", "111010110001", "111100010011", "1110110101", "1111100011", "1111010101", "111101101")
#: The same for the runs that are accepted of items with so few words.
SHORT = {
    5: ("1111",),
    6: ("11111",),
    7: ("111111", "1110111"),
    8: ("1111111", "11110111", "11101111"),
    9: ("11111111", "111110111", "111101111", "111011111"),
    10: ("11110111", "111011011"),
    11: ("1110110111", "111101111", "1111010111", "1110111011"),
}
#: Items under so many words overlap nothing: four words in a row, or fewer, are common in clean documents.
LEAST = 5
#: An overlap needs so many equal words, or this share of a short item's, and this share of its length.
WORDS, SHARE, IDENTITY = 10, 0.8, 0.7
#: Benchmark words that are broadcast at once; a larger benchmark is looked up block by block.
BLOCK_WORDS = 2_000_000


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits and non-ASCII, in lower case) of all texts, and each text's first word."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    starts, ends, first = word_spans(data, offsets, ALNUM)
    return span_hashes(data, starts, ends), first


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the masked words from each place on."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                out *= np.uint64(0xD6E8FEB86659FD93)
                out += words[k : k + n]
    return mix64(out)


class SeedIndex:
    """The seeds of some benchmark items: sorted hashes with (item, place), behind a bit table."""

    BITS = 22

    def __init__(self, ids: list[int], texts: list[str | None]):
        words, first = hashed_words(pa.array(texts, pa.string()))
        self.items = [(i, words[a:b]) for i, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist()) if b - a >= LEAST]
        masks = [SHORT.get(len(w), MASKS) for _, w in self.items]
        self.masks = sorted(set().union(*masks))
        self.seeds = []
        for mask in self.masks:
            keys, item, place = [], [], []
            for k, (_, w) in enumerate(self.items):
                if mask in masks[k]:
                    h = seed_hashes(w, mask)
                    keys.append(h)
                    item.append(np.full(len(h), k, np.int32))
                    place.append(np.arange(len(h), dtype=np.int32))
            h = np.concatenate([*keys, np.zeros(0, np.uint64)])
            order = np.argsort(h, kind="stable")
            shift = np.uint64(64 - min(self.BITS, (64 * len(h)).bit_length()))
            table = np.zeros(1 << 64 - int(shift), bool)
            table[(h >> shift).astype(np.int64)] = True
            cat = lambda x: np.concatenate([*x, np.zeros(0, np.int32)])[order]
            self.seeds.append((mask, shift, table, h[order], cat(item), cat(place)))

    def hits(self, words: np.ndarray):
        """(place among the words, item, place in the item) of each equal seed."""
        for mask, bits, table, keys, item, place in self.seeds:
            h = seed_hashes(words, mask)
            maybe = np.flatnonzero(table[(h >> bits).astype(np.int64)])
            low, high = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            for at, a, b in zip(maybe[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                for k in range(a, b):
                    yield at, len(mask), int(item[k]), int(place[k])

    def overlaps(self, words: np.ndarray, first: np.ndarray):
        """(row, item id, start in the row, start in the item, length, equal words): the best overlap of each row and item."""
        lines = defaultdict(set)
        for at, span, k, place in self.hits(words):
            row = int(np.searchsorted(first, at, side="right")) - 1
            if at + span <= first[row + 1]:
                lines[row, k].add(at - place)
        for (row, k), shifts in lines.items():
            best = None
            item = self.items[k][1]
            for shift in sorted(shifts):
                a, b = max(0, int(first[row]) - shift), min(len(item), int(first[row + 1]) - shift)
                start, end, equal = best_run(item[a:b] == words[shift + a : shift + b])
                if accepted(equal, end - start, len(item)) and (best is None or equal > best[3]):
                    best = (shift + a + start - int(first[row]), a + start, end - start, equal)
            if best is not None:
                yield (row, self.items[k][0], *best)


def accepted(equal: int, length: int, words: int) -> bool:
    """Whether a run of that length with so many equal words is an overlap with an item of so many words."""
    return equal >= min(WORDS, int(np.ceil(SHARE * words))) and equal >= IDENTITY * length


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the run with the best sum of +1 for a match and -2 for a difference; ties go to the first."""
    best, total, start, out = 0, 0, 0, (0, 0)
    for k, e in enumerate(equal.tolist()):
        total += 1 if e else -2
        if total > best:
            best, out = total, (start, k + 1)
        if total <= 0:
            total, start = 0, k + 1
    return (*out, int(equal[out[0] : out[1]].sum()))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id, doc_start, item_start, n_words, n_equal.

    Places are words. The benchmark is the query set: its size is counted, and blocks of at most block_words words (or
    one item) are looked up against all documents. Null or empty texts, and items under five words, overlap nothing;
    null doc_ids are kept; repeated rows each give their rows; other columns are not read; empty tables give no rows.
    """
    docs, out = named(docs, id_col, text_col), None
    for index, alone in indexes(docs.sparkSession, benchmark, block_words):
        part = docs.mapInArrow(_scan(index), "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long")
        if not alone:  # only one block's index lives at a time
            part = cut(part)
            index.unpersist()
        out = part if out is None else out.unionAll(part)
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns as they are, that overlap no benchmark item.

    Null and empty texts and null doc_ids stay, equal rows stay or go together, other columns are not read; an empty
    benchmark leaves all rows, an empty table gives none.
    """
    place, key = docs.columns.index("text"), "__overlap_key"
    found = None
    for index, alone in indexes(docs.sparkSession, benchmark, block_words):
        if alone:
            return docs.mapInArrow(_clean(index, place), docs.schema)
        rows = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
        part = cut(rows.mapInArrow(_scan(index), "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long").select(F.col("doc_id").alias(key)).distinct())
        index.unpersist()
        found = part if found is None else found.unionAll(part)
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found, key, "left_anti").select(*docs.columns)


def indexes(spark: SparkSession, benchmark: DataFrame, block_words: int):
    """A broadcast index for each block of the benchmark, and whether it is the only one."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().collect()
        yield spark.sparkContext.broadcast(SeedIndex([r[0] for r in rows], [r[1] for r in rows])), blocks == 1


def _clean(index, place):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, place):
                keep = np.ones(part.num_rows, bool)
                keep[[row for row, *_ in index.value.overlaps(*hashed_words(part.column(place)))]] = False
                yield part.filter(pa.array(keep))

    return run


def _scan(index):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                words, first = hashed_words(part.column(1))
                found = list(index.value.overlaps(words, first))
                if found:
                    rows, *columns = zip(*found)
                    ids = part.column(0).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"])

    return run


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
