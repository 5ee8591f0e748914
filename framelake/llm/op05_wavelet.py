"""Token ids in binary shards: a wavelet matrix per file, with rank and select over its bit-planes.

A file holds its planes in blocks, each compressed by itself, and the ranks at the blocks' edges, so that one token, a
count or an occurrence is found by reading one block of each plane.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, named, scratch, text_slices
from .op02_packing import vocabulary
from .tokens import BYTE_LEVEL, encoder

END_ID = 2
MAGIC = b"WVL2"
#: Bits of a block, and so between two entries of the rank directory.
BLOCK = 1 << 15
#: A file is closed at the first document that brings it to so many ids: what a task holds at once.
SHARD_IDS = 1 << 23
#: Bytes of text for each range of ids that a task writes, where the session's shuffle partitions would give it more.
RANGE_BYTES = 1 << 29
_POPCOUNT = np.array([bin(k).count("1") for k in range(256)], np.uint8)


class WaveletMatrix:
    """One bit-plane for each bit of the ids, highest first; after each plane the ids with bit 0 go before those with 1.

    ranks[plane][b] counts the ones before block b; load(plane, b) gives that block's bytes.
    """

    def __init__(self, n: int, ranks: list[np.ndarray], load: Callable[[int, int], np.ndarray]):
        self.n, self.ranks, self.depth, self._load = n, ranks, len(ranks), load
        self.zeros = [n - int(r[-1]) for r in ranks]
        self._last: dict[int, tuple[int, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        ids = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes, ranks, step = [], [], BLOCK // 8
        for level in range(depth - 1, -1, -1):
            ones = (ids >> level & 1).astype(bool)
            plane = np.packbits(ones)
            counts = np.add.reduceat(_POPCOUNT[plane], np.arange(0, len(plane), step), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
            planes.append(plane)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]))
            ids = np.concatenate([ids[~ones], ids[ones]])
        return cls(len(ids), ranks, lambda level, block: planes[level][block * step : (block + 1) * step])

    def block(self, level: int, number: int) -> np.ndarray:
        if self._last.get(level, (-1,))[0] != number:
            self._last[level] = number, self._load(level, number)
        return self._last[level][1]

    def plane(self, level: int) -> np.ndarray:
        return np.concatenate([self._load(level, b) for b in range(len(self.ranks[level]) - 1)] + [np.zeros(0, np.uint8)])

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the last to the first."""
        ids = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        for k in range(self.depth - 1, -1, -1):
            ones = np.unpackbits(self.plane(k), count=self.n).view(bool)
            zeros = ~ones
            split = self.zeros[k]
            out = np.empty_like(ids)
            out[zeros] = ids[:split]
            out[ones] = ids[split:] | ids.dtype.type(1 << (self.depth - 1 - k))
            ids = out
        return ids

    def _ones(self, level: int, end: int) -> int:
        number, rest = divmod(end, BLOCK)
        n = int(self.ranks[level][number])
        if rest:
            block = self.block(level, number)
            n += int(_POPCOUNT[block[: rest // 8]].sum())
            n += bin(block[rest // 8] >> (8 - rest % 8)).count("1") if rest % 8 else 0
        return n

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(f"place {at} of {self.n}")
        value = 0
        for k in range(self.depth):
            bit = self.block(k, at // BLOCK)[at % BLOCK // 8] >> (7 - at % 8) & 1
            ones = self._ones(k, at)
            at = self.zeros[k] + ones if bit else at - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        first = 0
        if value >> self.depth:
            return 0, 0
        for k in range(self.depth):
            a, b = self._ones(k, first), self._ones(k, end)
            first, end = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.depth - 1 - k) & 1 else (first - a, end - b)
        return first, end

    def rank(self, value: int, end: int) -> int:
        """How often an id occurs before a place."""
        first, end = self._range(value, end)
        return end - first

    def select(self, value: int, nth: int) -> int:
        """The place of the nth occurrence of an id, from 0."""
        first, end = self._range(value, self.n)
        if not 0 <= nth < end - first:
            raise IndexError(f"id {value} occurs {end - first} times")
        at = first + nth
        for k in range(self.depth - 1, -1, -1):
            one = value >> (self.depth - 1 - k) & 1
            at = self._select_bit(k, at - self.zeros[k] if one else at, one)
        return at

    def _select_bit(self, level: int, nth: int, one: int) -> int:
        ranks = self.ranks[level] if one else np.arange(len(self.ranks[level])) * BLOCK - self.ranks[level]
        number = int(np.searchsorted(ranks, nth, side="right")) - 1
        bits = np.unpackbits(self.block(level, number))
        return number * BLOCK + int(np.flatnonzero(bits == one)[nth - int(ranks[number])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.rank(value, self.n))]

    def to_bytes(self, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
        """Magic, header length, JSON header; the documents' ids and ends, ranks and block sizes; the blocks of each plane."""
        pack = zstandard.ZstdCompressor(level=1).compress
        blocks = [pack(self._load(k, b).tobytes()) for k in range(self.depth) for b in range(len(self.ranks[k]) - 1)]
        parts = [pack(json.dumps(doc_ids).encode()), pack(ends.astype("<i8").tobytes()), pack(np.concatenate(self.ranks).astype("<i8").tobytes()), pack(np.array([len(b) for b in blocks], "<i8").tobytes())]
        header = json.dumps({"ids": self.n, "documents": len(doc_ids), "depth": self.depth, "block": BLOCK, "parts": [len(p) for p in parts]}).encode()
        return MAGIC + struct.pack("<I", len(header)) + header + b"".join(parts + blocks)


def open_shard(source) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the documents' ids and where each document ends; source is an open file or bytes.

    Of the file only the directory is read; the matrix reads the blocks that it is asked for.
    """
    if isinstance(source, bytes):
        source = pa.BufferReader(source)
    read = lambda size, at: bytes(source.read_at(size, at))
    if read(4, 0) != MAGIC:
        raise ValueError("not a wavelet shard")
    size = struct.unpack("<I", read(4, 4))[0]
    header, at, parts = json.loads(read(size, 8)), 8 + size, []
    for n in header["parts"]:
        parts.append(zstandard.ZstdDecompressor().decompress(read(n, at)))
        at += n
    if header["block"] != BLOCK:
        raise ValueError("another block size")
    depth = header["depth"]
    ranks = np.frombuffer(parts[2], "<i8").reshape(depth, -1)
    sizes = np.frombuffer(parts[3], "<i8")
    first, blocks = at + np.cumsum(sizes) - sizes, ranks.shape[1] - 1

    def load(level: int, block: int) -> np.ndarray:
        k = level * blocks + block
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(read(int(sizes[k]), int(first[k]))), np.uint8)

    return WaveletMatrix(header["ids"], list(ranks), load), json.loads(parts[0]), np.frombuffer(parts[1], "<i8")


def store(path: str, data: bytes) -> None:
    """Writes a file whole: under another name first, as a task may be lost or run twice."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    draft = f"{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, name)


def fetch(path: str) -> bytes:
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as f:
        return f.read()


def open_file(path: str):
    """The file for random access; open_shard(open_file(path)) reads one id without the rest."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes all documents' ids, each document's followed by end_id, in ascending doc_id order (nulls first).

    Rows of one doc_id, null among them, go by a hash of their texts, so many of them are dealt over several tasks;
    only equal rows stay together. A task writes a file whenever it has shard_ids ids, so it holds no more than these
    and one block of texts, however large its range. A null or empty text is the end id alone; other columns are not
    read; an empty table gives no shard. Returns shard (in order), path, documents, n_tokens, start (ids before it).
    """
    path = path or vocabulary("byte_bpe_50k.json")
    docs = named(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    docs = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(ranges, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches):
        coder = encoder(path, BYTE_LEVEL)
        fs, name = pyarrow.fs.FileSystem.from_uri(folder)
        task, number = TaskContext.get().partitionId(), 0
        ids, doc_ids, ends, total = [], [], [], 0

        def close():
            fs.create_dir(name, recursive=True)
            store(to := f"{folder}/shard-{task:06d}-{number:06d}.wvlt", WaveletMatrix.build(np.concatenate(ids)).to_bytes(doc_ids, np.concatenate(ends)))
            return pa.RecordBatch.from_pylist([{"task": task, "number": number, "path": to, "documents": len(doc_ids), "n_tokens": total}])

        for batch in batches:
            for part in text_slices(batch, 1):
                got, offsets = coder.encode(part.column(1), end_id)
                ids.append(got.astype(np.uint16) if not len(got) or got.max() < 65536 else got)
                doc_ids += part.column(0).to_pylist()
                ends.append(total + offsets[1:])
                total += len(got)
                if total >= shard_ids:
                    yield close()
                    ids, doc_ids, ends, total, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close()

    files = cut(docs.mapInArrow(run, "task long, number long, path string, documents long, n_tokens long"))
    # ids before a file: those of blocks of tasks before its block, of tasks before its own, of files before it
    block = F.floor(F.col("task") / 1024)
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    tasks = files.groupBy("task").agg(F.sum("n_tokens").alias("size")).withColumn("block", block)
    blocks = tasks.groupBy("block").agg(F.sum("size").alias("s")).select("block", F.coalesce(F.sum("s").over(before(F.lit(0)).orderBy("block")), F.lit(0)).alias("b0"))
    tasks = tasks.withColumn("b1", F.coalesce(F.sum("size").over(before("block").orderBy("task")), F.lit(0))).join(blocks, "block").select("task", (F.col("b0") + F.col("b1")).alias("base"))
    files = files.withColumn("inner", F.coalesce(F.sum("n_tokens").over(before("task").orderBy("number")), F.lit(0))).join(tasks, "task")
    return files.select((F.col("task") * (1 << 24) + F.col("number")).alias("shard"), "path", "documents", "n_tokens", (F.col("base") + F.col("inner")).alias("start"))


def read_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32[, ids]."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix, doc_ids, ends = open_shard(fetch(row["path"]))
                ids = matrix.decode().astype("<u4")
                view = memoryview(ids).cast("B")
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([starts, ends[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    shards = shards.select("path", "start")
    return shards.repartition(max(1, shards.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(run, schema)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(documents(spark, sf_dir), scratch(spark, "shards")))
