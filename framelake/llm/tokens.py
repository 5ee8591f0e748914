"""Exact tokenisation by the tokenizers library, with a bounded table of white-space chunks.

Both vocabularies cut a text before they merge, and never join characters across the cuts made here, so the ids of a
text are the ids of its chunks in a row. Chunks are cut and hashed for a whole block of texts at once; each is encoded
by the library once for each fill of the table.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import NOT_SPACE, span_hashes, text_bytes, word_spans

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: A word takes the one space before it; of other white space all but the last character goes together.
BYTE_LEVEL = "byte"
#: White space is dropped.
WORD_LEVEL = "word"
#: Slots of the chunk table, a power of two, of which at most three quarters are filled.
SLOTS = 1 << 22
#: UTF-8 of the white space above ASCII: first byte, then the range of what follows. Such texts are encoded whole.
WIDE_SPACE = {0xC2: [(b"\x85", b"\x85"), (b"\xa0", b"\xa0")], 0xE1: [(b"\x9a\x80", b"\x9a\x80")], 0xE2: [(b"\x80\x80", b"\x80\x8a"), (b"\x80\xa8", b"\x80\xa9"), (b"\x80\xaf", b"\x80\xaf"), (b"\x81\x9f", b"\x81\x9f")], 0xE3: [(b"\x80\x80", b"\x80\x80")]}


def wide_space(data: np.ndarray) -> np.ndarray:
    """Where a white-space character above ASCII begins."""
    found = []
    for lead, ranges in WIDE_SPACE.items():
        at = np.flatnonzero(data == lead)
        if len(at):
            n = len(ranges[0][0])
            at = at[at + n < len(data)]
            follow = sum(data[at + 1 + k].astype(np.int64) << 8 * (n - 1 - k) for k in range(n))
            hit = np.zeros(len(at), bool)
            for low, high in ranges:
                hit |= (follow >= int.from_bytes(low, "big")) & (follow <= int.from_bytes(high, "big"))
            found.append(at[hit])
    return np.concatenate([*found, np.zeros(0, np.int64)])


def byte_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks that tile each text."""
    n = len(data)
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    space = ~NOT_SPACE[data]
    turn = np.empty(n, bool)
    turn[:1] = True
    np.not_equal(space[1:], space[:-1], out=turn[1:])
    turn |= row[:n]
    start = turn & space
    word = np.flatnonzero(turn & ~space)
    inner = word[~row[word]]
    start[inner - 1] = True
    start[word[row[word]]] = True
    start[inner[data[inner - 1] != 32]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


class ChunkEncoder:
    """Encodes texts to ids; path is a tokenizer file, kind how its vocabulary treats white space."""

    def __init__(self, path: str, kind: str, slots: int = SLOTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind, self.slots = kind, slots
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.which = np.full(self.slots, -1, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.first = np.zeros(1 << 15, np.int32)
        self.used, self.n = 0, 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each chunk, or -1."""
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.which[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.which[at] >= 0))
        at = at[open_]
        while len(open_):
            at = at + 1 & self.slots - 1
            got = np.where(self.keys[at] == keys[open_], self.which[at], -1)
            out[open_] = got
            more = (got < 0) & (self.which[at] >= 0)
            open_, at = open_[more], at[more]
        return out

    def insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Adds distinct keys that are not there: of those that want a free slot, the last one gets it."""
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.which[at] < 0
            self.which[at[free]] = numbers[left[free]]
            done = self.which[at] == numbers[left]
            self.keys[at[done]] = keys[left[done]]
            left, at = left[~done], at[~done] + 1 & self.slots - 1

    def learn(self, chunks: list[str]) -> None:
        for k in range(0, len(chunks), 20_000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(chunks[k : k + 20_000], add_special_tokens=False)]
            flat = np.array([i for ids in lists for i in ids], self.ids.dtype)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while self.n + len(lists) + 1 > len(self.first):
                self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.first[self.n + 1 : self.n + 1 + len(lists)] = self.used + np.cumsum(sizes)
            self.used += len(flat)
            self.n += len(lists)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by end_id, and each text's offsets among them."""
        data, offsets = text_bytes(texts)
        wide = np.unique(np.searchsorted(offsets, wide_space(data), side="right") - 1)
        if len(wide):
            return self._around(texts, wide, end_id)
        if self.kind == BYTE_LEVEL:
            starts, ends = byte_chunks(data, offsets)
        else:
            starts, ends, _ = word_spans(data, offsets, NOT_SPACE)
        if self.n + len(starts) > self.slots * 3 // 4:
            self.clear()
        keys = span_hashes(data, starts, ends)
        which = self.find(keys)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            whole = data.tobytes()
            number = self.n
            self.learn([whole[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self.insert(new, np.arange(number, self.n, dtype=np.int32))
            which[missing] = self.find(keys[missing])
        start = self.first[which].astype(np.int64)
        length = self.first[which + 1] - start
        stop = np.concatenate([[0], np.cumsum(length)])
        out = stop[np.searchsorted(starts, offsets)] + np.arange(len(offsets))  # a text's end id stands behind its chunks
        ids = np.empty(out[-1], np.uint32)
        take = np.arange(stop[-1], dtype=np.int64) + np.repeat(start - stop[:-1], length)
        put = np.ones(out[-1], bool)
        put[out[1:] - 1] = False
        ids[put] = self.ids[take]
        ids[out[1:] - 1] = end_id
        return ids, out

    def _around(self, texts: pa.Array, wide: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() where the texts numbered in wide are encoded whole."""
        parts, sizes, first = [], [], 0
        for k in [*wide.tolist(), len(texts)]:
            if k > first:
                ids, offsets = self.encode(texts.slice(first, k - first), end_id)
                parts.append(ids)
                sizes += np.diff(offsets).tolist()
            if k < len(texts):
                ids = np.array([*self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, end_id], np.uint32)
                parts.append(ids)
                sizes.append(len(ids))
            first = k + 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> ChunkEncoder:
    """The worker's encoder; it outlives a task, and so does its table."""
    return ChunkEncoder(path, kind)
