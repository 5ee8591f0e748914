"""Packing of token sequences by first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, named, text_slices
from .tokens import WORD_LEVEL, encoder

LENGTH = 2048
#: Documents, and bytes of text, that make a group; a longer document's pieces go on to the next groups.
GROUP = 4096
GROUP_BYTES = 1 << 25
SPREAD = 256
END_ID = 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BinTree:
    """A tournament tree over the room left in bins: the winner of each match is the larger room.

    first_fit finds the leftmost bin with room for a length in one walk from the root.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, length: int) -> int:
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        room[node] -= length
        at, left = node - self.leaves, room[node]
        while node > 1:
            node //= 2
            winner = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == winner:
                break
            room[node] = winner
        return at


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each length; a length of capacity has a bin of its own."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    whole = int((lengths >= capacity).sum())
    bins[order[:whole]] = np.arange(whole)
    tree, used = BinTree(len(lengths) - whole, capacity), [0] * (len(lengths) - whole)
    for k in order[whole:].tolist():
        n = int(lengths[k])
        at = tree.first_fit(n)
        bins[k], offsets[k] = whole + at, used[at]
        used[at] += n
    return bins, offsets


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenises each document and cuts it into whole sequences and one rest: g, doc_id, start, length, ids_crc32, doc_tokens[, ids].

    docs are doc_id, text and g, which each piece keeps.
    """

    def run(batches):
        coder = encoder(path, WORD_LEVEL)
        for batch in batches:
            for part in text_slices(batch, 1):
                ids, offsets = coder.encode(part.column(1), end_id)
                ids = ids.astype("<u4")
                count = np.diff(offsets)
                n = -(-count // length)
                row = np.repeat(np.arange(len(count)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(length, count[row] - start)
                first = offsets[row] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), size.tolist())]
                take = pa.array(row)
                columns = [part.column(2).take(take), part.column(0).take(take), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(count[row])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["g", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return docs.mapInArrow(run, "g long, " + PIECE + ", ids array<int>" * with_ids)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Packs documents into sequences of at most length ids.

    A document's ids are cut every length ids, so all but its last piece fill a sequence; each random group of documents
    is packed first-fit decreasing by one task alone. Groups are drawn for rows, not by a column, so neither a hot key
    nor repeated rows make one large; there are enough for about group documents and 32 MB of text in each, and a
    document of more than 256 pieces goes on in the next groups, so a group's pieces are bounded. The draw is written
    down before it is used: a task that runs again deals rows as before. A null or empty text is the end id alone; a null
    doc_id is kept; other columns are not read; an empty table gives no rows. with_ids adds the ids of each piece.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id (group * 2**32 + bin), offset.
    """
    docs = named(docs, id_col, text_col)
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-rows // group), -(-(size or 0) // GROUP_BYTES))
    drawn = docs.withColumn("g", F.floor(F.rand(seed) * groups).cast("long"))
    found = pieces(drawn, path or vocabulary("word_bpe_49k.json"), length, end_id, with_ids)
    found = cut(found.withColumn("g", F.expr(f"pmod(g + start div {length * SPREAD}, {groups})")))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), length)
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins))
        return table.append_column("offset", pa.array(offsets)).drop_columns(["g"])

    schema = PIECE + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return found.groupBy("g").applyInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
