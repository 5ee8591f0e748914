"""Language identification by unigram piece models whose score sums over all segmentations of a text."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, named, text_slices
from .op02_packing import vocabulary

#: Labelled documents, and bytes of their texts, that a model is fitted on, drawn by a hash of the id: the bounds of the sample.
TRAIN_DOCS = 3000
TRAIN_BYTES = 64 << 20
ROUNDS = 3
#: Characters of a word that are fitted in one go; all parts of longer words count. Scores sum over whole words.
PART = 1024
#: Places whose pieces are looked up at once, and characters of the words that are scored at once.
STRIP, CELLS = 4096, 1 << 17
#: Words above so many characters are scored with a scale for each language, and words of unequal lengths together.
LONG = 48
#: Words kept by a worker with their scores.
CACHE = 200_000
MARK = "▁"
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
UND = "und"


class PieceTable:
    """Finds pieces by hash; a multiplicative table with linear probing, all in numpy."""

    BASE = np.uint64(1_000_003)
    BITS = 18

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self.key(p) for p in pieces], np.uint64)
        self.keys, self.values = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.probes = 1
        for k, (key, at) in enumerate(zip(keys.tolist(), self.slot(keys).tolist())):
            n = 1
            while self.values[at] >= 0:
                at, n = (at + 1) % len(self.keys), n + 1
            self.keys[at], self.values[at] = key, k
            self.probes = max(self.probes, n)

    @classmethod
    def key(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(cls.BASE) + ord(c) + 1) % (1 << 64)
        return h

    @classmethod
    def slot(cls, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - cls.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, or -1."""
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        for _ in range(1, self.probes):
            missing = np.flatnonzero((out < 0) & (self.values[at] >= 0))
            if not len(missing):
                break
            at = (at + 1) % len(self.keys)
            hit = missing[self.keys[at[missing]] == keys[missing]]
            out[hit] = self.values[at[hit]]
        return out


def lattice(codes: np.ndarray, table: PieceTable, low: int, high: int) -> list[list[tuple[int, np.ndarray]]]:
    """For each end in (low, high] of words given as a matrix of code points: (size, piece of each word or -1) of all spans.

    Behind a shorter word's end stand zeros, which no piece covers.
    """
    begin = max(0, low + 1 - table.longest)
    codes = codes[:, begin:high]
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(high - low)]
    with np.errstate(over="ignore"):
        keys = np.zeros(codes.shape, np.uint64)
        for size in range(1, min(table.longest, codes.shape[1]) + 1):
            keys = keys[:, : codes.shape[1] - size + 1] * table.BASE + codes[:, size - 1 :] + np.uint64(1)
            found = table.find(keys.ravel()).reshape(keys.shape)
            for start in np.flatnonzero((found >= 0).any(0)).tolist():
                if (end := begin + start + size) > low:
                    out[end - low - 1].append((size, found[:, start]))
    return out


class UnigramModel:
    """Piece probabilities by language; probs has a row for each piece, the last one all zeros for "no piece"."""

    def __init__(self, table: PieceTable, languages: list[str], probs: np.ndarray):
        self.table, self.languages, self.probs = table, languages, probs

    def forward(self, codes: np.ndarray, keep: bool = False):
        """(end, alpha[word, language] over scale, log scale) for each place of the words, from 0 on; alpha is not kept longer than pieces reach."""
        n, length = codes.shape
        alpha = [np.ones((n, len(self.languages)))]
        apart = length > LONG  # a scale for each language
        scale = [np.zeros((n, len(self.languages) if apart else 1))]
        yield 0, alpha[0], scale[0]
        for low in range(0, length, STRIP):
            for end, spans in enumerate(lattice(codes, self.table, low, min(length, low + STRIP)), low + 1):
                total, single = 0.0, False
                for size, which in reversed(spans):
                    part = alpha[end - size] * self.probs[which]
                    if size > 1:
                        part *= np.exp(scale[end - size] - scale[end - 1])
                    else:
                        part += alpha[end - 1] * (which < 0)[:, None] * UNKNOWN
                        single = True
                    total = total + part
                if not single:
                    total = total + alpha[end - 1] * UNKNOWN
                top = total if apart else total.max(1, keepdims=True)
                alpha.append(total / top)
                scale.append(scale[end - 1] + np.log(top))
                yield end, alpha[end], scale[end]
                if not keep and end >= self.table.longest:
                    alpha[end - self.table.longest] = scale[end - self.table.longest] = None

    def score(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over all segmentations of the whole word; one row for each word."""
        out = np.empty((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length in [k for k in by_length if k <= LONG]:
            rows = by_length[length]
            for a in range(0, len(rows), 4096):
                self._score([MARK + words[i] for i in rows[a : a + 4096]], rows[a : a + 4096], out)
        some, cells = [], 0
        for length in sorted(k for k in by_length if k > LONG):
            for i in by_length[length]:
                if some and (cells + length > CELLS or length > 2 * len(words[some[0]])):
                    self._score([MARK + words[j] for j in some], some, out)
                    some, cells = [], 0
                some.append(i)
                cells += length
        if some:
            self._score([MARK + words[j] for j in some], some, out)
        return out

    def _score(self, words: list[str], rows: list[int], out: np.ndarray) -> None:
        rows, sizes = np.array(rows), np.array([len(w) for w in words])
        ends = set(sizes.tolist())
        for end, alpha, scale in self.forward(code_points(words)):
            if end in ends:
                done = sizes == end
                out[rows[done]] = (np.log(np.maximum(alpha, 1e-300)) + scale)[done]


def parts(word: str) -> list[str]:
    """A word with its mark, cut where it is longer than PART."""
    return [MARK + word[:PART], *(word[k : k + PART] for k in range(PART, len(word), PART))]


def code_points(words: list[str]) -> np.ndarray:
    width = max(map(len, words))
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)


def expected_counts(table: PieceTable, probs: np.ndarray, counts: Counter) -> np.ndarray:
    """Forward-backward over the parts of distinct words: how often each piece is used, in expectation, in one language."""
    model = UnigramModel(table, [""], probs[:, None])
    out = np.zeros(len(probs))
    cut: Counter = Counter()
    for w, n in counts.items():
        for part in parts(w):
            cut[part] += n
    by_length: dict[int, list[str]] = {}
    for w in cut:
        by_length.setdefault(len(w), []).append(w)
    for length, words in by_length.items():
        step = max(1, min(4096, CELLS // length))
        for a in range(0, len(words), step):
            some = words[a : a + step]
            codes = code_points(some)
            _, alpha, scale = zip(*((e, x[:, 0], s[:, 0]) for e, x, s in model.forward(codes, keep=True)))
            weight = np.array([cut[w] for w in some], float)
            spans = lattice(codes, table, 0, length)
            beta = [np.zeros(len(some)) for _ in range(length + 1)]
            beta[-1] = 1 / alpha[-1]
            for end in range(length, 0, -1):
                single = False
                for size, which in spans[end - 1]:
                    p = probs[which]
                    if size == 1:
                        p = p + UNKNOWN * (which < 0)
                        single = True
                    flow = p * beta[end] * np.exp(scale[end - size] - scale[end])
                    beta[end - size] += flow
                    hit = which >= 0
                    out += np.bincount(which[hit], (alpha[end - size] * flow * weight)[hit], len(out))
                if not single:
                    beta[end - 1] += UNKNOWN * beta[end] * np.exp(scale[end - 1] - scale[end])
    return out


def vocabulary_pieces(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]
    return [p for p in dict.fromkeys(pieces) if MARK not in p[1:]]  # words are scored apart


def fit(samples: list[tuple[str, str]], path: str, rounds: int = ROUNDS) -> UnigramModel:
    """Expectation-maximisation of each language's piece probabilities from (language, text) samples."""
    table = PieceTable(vocabulary_pieces(path))
    by_language: dict[str, Counter] = {}
    for language, text in samples:
        by_language.setdefault(language, Counter()).update(text.split())
    languages = sorted(by_language)
    probs = np.zeros((len(table.pieces) + 1, len(languages)))
    for j, language in enumerate(languages):
        counts = by_language[language]
        p = np.ones(len(table.pieces) + 1)
        p[-1] = 0
        p /= p.sum()
        for _ in range(rounds):
            p = expected_counts(table, p, counts)[: len(p)]
            p[:-1] += 0.05
            p[-1] = 0
            p /= p.sum()
        probs[:, j] = p
    return UnigramModel(table, languages, probs)


def training_sample(docs: DataFrame, bound: int = TRAIN_DOCS, bound_bytes: int = TRAIN_BYTES) -> list[tuple[str, str]]:
    """At most bound labelled documents of at most bound_bytes outside the held-out quarter, the same ones on each run."""
    learn = docs.where("lang is not null and text is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2")
    learn = learn.select("doc_id", F.xxhash64("text").alias("h"), "lang", "text")
    first = learn.select("doc_id", "h", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(bound).collect()
    chosen, total = [], 0
    for row in first:
        if total + row["size"] <= bound_bytes:
            chosen.append((row["doc_id"], row["h"]))
            total += row["size"]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame(sorted(set(chosen)), "doc_id long, h long")
    rows = learn.join(F.broadcast(ids), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.min(F.struct("lang", "text")).alias("r"))
    return [(r.lang, r.text) for r in rows.orderBy("doc_id", "h").select("r.lang", "r.text").collect()]


def with_language(docs: DataFrame, path: str | None = None, bound: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language; those that would be und go.

    These are rows with a null or empty text or one without a letter. Null doc_ids and repeated rows stay; without a
    labelled document no model is fitted and rows with a letter stay; an empty table gives no rows.
    """
    samples = training_sample(docs, bound)
    if not samples:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(samples, path or vocabulary("piece_bpe_32k.model")))
    places = [docs.columns.index("doc_id"), docs.columns.index("text")]
    score = _scorer(shared)

    def run(batches):
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(k) for k in places], ["doc_id", "text"])
            found = [name for part in score([pair]) for name in part.column(2).to_pylist()]
            yield batch.filter(pa.array([name != UND for name in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: UnigramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each whole text.

    Words (runs without white space) are scored apart, as no piece joins two; a text's score is the sum over its words.
    score is the posterior of the best language at the text's mean per-word evidence scaled to at most 20 words. A null text,
    or one without a letter, gets und and score 0. A null doc_id is kept and not held out; repeated rows each give a
    row; other columns are not read; an empty table gives no rows. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return named(docs, id_col, text_col).mapInArrow(_scorer(shared), schema)


def _scorer(shared):
    def run(batches):
        model = shared.value
        names = [*model.languages, UND]
        at: dict[str, int] = {}
        scores = np.zeros((1 << 12, len(model.languages)))
        for batch in batches:
            for part in text_slices(batch, 1):
                column = part.column(1)
                letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                words, counts = [], []
                for text in column.to_pylist():
                    found = text.split() if text else []
                    words += found
                    counts.append(len(found))
                if len(at) > CACHE:
                    at.clear()
                if new := list(dict.fromkeys(w for w in words if w not in at)):
                    first = len(at)
                    while first + len(new) > len(scores):
                        scores = np.concatenate([scores, np.zeros_like(scores)])
                    scores[first : first + len(new)] = model.score(new)
                    at.update(zip(new, range(first, first + len(new))))
                which = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
                sums = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(scores[which], 0)])
                ends = np.cumsum(counts)
                n = np.maximum(1, np.array(counts))
                total = sums[ends] - sums[ends - counts]
                total = total / n[:, None] * np.minimum(n, 20)[:, None]
                odds = np.exp(total - total.max(1, keepdims=True))
                odds /= odds.sum(1, keepdims=True)
                best = np.where(letters, odds.argmax(1), len(model.languages))
                score = np.where(letters, odds.max(1), 0.0)
                ids = part.column(0)
                held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array([names[b] for b in best]), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, path: str | None = None, bound: int = TRAIN_DOCS) -> DataFrame:
    """Fits on the labelled documents of docs and predicts all, as predict() does; without a labelled document all are und.

    Columns: doc_id, text and lang are read, others are not; null langs are not learned; an empty table gives no rows.
    """
    samples = training_sample(docs, bound)
    if not samples:
        return named(docs).select("doc_id", F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2"), F.lit(False)).alias("held_out"), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    return predict(docs, fit(samples, path or vocabulary("piece_bpe_32k.model")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
