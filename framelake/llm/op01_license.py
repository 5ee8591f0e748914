"""Licence scans by a positional index of rare words."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, named, text_slices

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Passages of public licence texts, and phrases without which a match does not count.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "sublicense and or sell copies"]),
    "apache-2": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["licensed under the apache license", "except in compliance with the license"]),
    "bsd-3-clause": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["redistribution and use in source and binary forms", "endorse or promote products"]),
    "bsd-2-clause": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this software is provided by the copyright holders and contributors as is", ["redistribution and use in source and binary forms", "provided by the copyright holders and contributors"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"]),
    "0bsd": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software", ["with or without fee is hereby granted the software is provided as is"]),
    "gpl-2": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "either version 2 of the license"]),
    "gpl-3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "either version 3 of the license"]),
    "lgpl-2.1": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["gnu lesser general public license", "either version 2 1 of the license"]),
    "lgpl-3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu lesser general public license", "either version 3 of the license"]),
    "agpl-3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license", "either version 3 of the license"]),
    "gfdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation", ["under the terms of the gnu free documentation license"]),
    "epl-1": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html", ["eclipse public license v1 0"]),
    "epl-2": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ["eclipse public license 2 0"]),
    "cddl-1": ("the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", ["common development and distribution license"]),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["including commercial applications and to alter it and redistribute it freely"]),
    "bsl-1": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", ["any person or organization obtaining a copy of the software and accompanying documentation"]),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", ["without fee and without a written agreement is hereby granted"]),
    "psf-2": ("this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation", ["between the python software foundation psf and the individual or organization"]),
    "artistic-2": ("this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed the intent is that the copyright holder maintains some artistic control over the development of that package", ["given free software package may be copied modified distributed"]),
    "ms-pl": ("this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software", ["this license governs use of the accompanying software"]),
    "ofl-1.1": ("this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at", ["sil open font license version 1 1"]),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ["changing it is allowed as long as the name is changed"]),
    "cc-by-4": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    "cc-by-sa-4": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0 international"]),
    "cc-by-nc-4": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0 international"]),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    "cc0-1": ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ["dedicated the work to the public domain"]),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software released into the public domain"]),
}
#: Share of a template's words that have to stand in order.
COVERAGE = 0.7
#: Postings of a template are its words of highest IDF that make up the share that may be missing, and so many more
#: places: a text that covers a template holds so many of them at one relative position.
MORE = 2
#: Words by which parts of one passage may be shifted against each other.
SHIFT = 4
#: Words (clauses that a template leaves out) that may stand between two key phrases besides its own.
GAP = 60

#: Bytes of words to themselves, A-Z in lower case, all others to a space.
TO_WORDS = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


class RareWordIndex:
    """Postings (entry, position) for the rarest words of each phrase and template.

    idf gives each word's inverse document frequency in the corpus; without it that of the entries themselves counts.
    """

    def __init__(self, phrases: dict[str, str], templates: dict[str, tuple[str, list[str]]], idf: dict[bytes, float] | None = None):
        self.entries = [(p.encode().split(), label, None) for p, label in phrases.items()]
        self.entries += [(t.encode().split(), label, [k.encode().split() for k in keys]) for label, (t, keys) in templates.items()]
        df = Counter(w for words, _, _ in self.entries for w in set(words))
        idf = idf or {}
        self.idf = {w: idf.get(w, math.log(len(self.entries) / n)) for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.posted: list[int] = []
        for k, (words, _, keys) in enumerate(self.entries):
            least = math.floor((1 - COVERAGE) * len(words)) + MORE if keys else 2
            rare: set[bytes] = set()
            for w in sorted(set(words), key=lambda w: (-self.idf[w], -len(w), w)):
                if sum(x in rare for x in words) < least:
                    rare.add(w)
            places = [(i, w) for i, w in enumerate(words) if w in rare]
            self.posted.append(len(places))
            for i, w in places:
                self.postings[w].append((k, i))
        self.words = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[int], dict[str, float], set[str]]:
        """Starts of base phrases (one for each place), scores by label, base labels."""
        if self.words.isdisjoint(words):
            return [], {}, set()
        at: dict[bytes, list[int]] = defaultdict(list)
        for place, word in enumerate(words):
            if word in self.words:
                at[word].append(place)
        near: dict[int, Counter] = defaultdict(Counter)
        for word in sorted(at, key=lambda w: -self.idf[w]):  # the text's licence words, those of highest IDF first
            for k, i in self.postings[word]:
                near[k].update(place - i for place in at[word])
        starts, scores, base, whole = [], {}, set(), None
        for k, votes in near.items():
            entry, label, keys = self.entries[k]
            if keys is None:
                for start, n in votes.items():
                    if n == self.posted[k] and start >= 0 and words[start : start + len(entry)] == entry:
                        starts.append(start)
                        base.add(label)
                        scores[label] = 1.0
                continue
            if votes.total() < MORE:
                continue
            whole = whole or b" " + b" ".join(words) + b" "
            if not all(b" " + b" ".join(key) + b" " in whole for key in keys):
                continue
            for shift in aligned(votes):
                part = words[max(0, shift - SHIFT) : max(0, shift + len(entry) + SHIFT)]
                if all(_stands(key, part) for key in keys):
                    share = _in_order(entry, part) / len(entry)
                    if share >= max(COVERAGE, scores.get(label, 0)):
                        scores[label] = share
            if label not in scores and len(keys) > 1:
                share = self.chained(k, words)
                if share >= COVERAGE:
                    scores[label] = share
        return starts, scores, base

    def chained(self, k: int, words: list[bytes]) -> float:
        """The best share of a template's words that stand in order in an extent where its key phrases follow each other.

        An extent that holds a key phrase of another template, and this template does not, is that licence's.
        """
        template, _, keys = self.entries[k]
        if not all(_stands(key, words) for key in keys):
            return 0.0
        own = [_places(key, template)[0] for key in keys]
        found = [_places(key, words) for key in keys]
        foreign = [key for _, _, others in self.entries for key in others or () if not _stands(key, template)]
        best = 0.0
        for first in found[0]:
            last = first
            for places, before, after in zip(found[1:], own, own[1:]):
                near = bisect_left(places, last + after - before - SHIFT)
                if near == len(places) or places[near] > last + after - before + GAP:
                    break
                last = places[near]
            else:
                low, high = max(0, first - own[0]), last + len(template) - own[-1]
                if not any(_stands(key, words[low:high]) for key in foreign):
                    best = max(best, _in_order(template, words[max(0, low - SHIFT) : high + SHIFT]) / len(template))
        return best


def aligned(votes: Counter) -> list[int]:
    """The relative positions that are at most SHIFT words from MORE votes within SHIFT words."""
    shifts = sorted(votes)
    out, low, total = set(), 0, 0
    for high, shift in enumerate(shifts):
        total += votes[shift]
        while shift - shifts[low] > SHIFT:
            total -= votes[shifts[low]]
            low += 1
        if total >= MORE:
            out.update(shifts[low : high + 1])
    return sorted({s + k for s in out for k in range(-SHIFT, SHIFT + 1)})


def _stands(key: list[bytes], words: list[bytes]) -> bool:
    return b" " + b" ".join(key) + b" " in b" " + b" ".join(words) + b" "


def _places(key: list[bytes], words: list[bytes]) -> list[int]:
    return [at for at, word in enumerate(words) if word == key[0] and words[at : at + len(key)] == key]


def _in_order(a: list[bytes], b: list[bytes]) -> int:
    """Words of the longest common subsequence."""
    row = [0] * (len(a) + 1)
    for word in b:
        before = 0
        for j, other in enumerate(a, 1):
            before, row[j] = row[j], before + 1 if word == other else max(row[j], row[j - 1])
    return row[-1]


@lru_cache(maxsize=1)
def default_index() -> RareWordIndex:
    return RareWordIndex(PHRASES, TEMPLATES)


def licence_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, float]:
    """The inverse document frequency of each licence word, over all documents; the words are those of the index."""
    known = default_index().idf

    def run(batches):
        count: Counter = Counter()
        n = 0
        for batch in batches:
            for part in text_slices(batch, 1):
                for value in part.column(1):
                    n += 1
                    if value.is_valid:
                        count.update(known.keys() & set(value.as_buffer().to_pybytes().translate(TO_WORDS).split()))
        rows = [(w.decode(), c) for w, c in count.items()] + [("", n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

    rows = named(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").sum("n").collect()
    found = {w.encode(): n for w, n in rows}
    total = found.pop(b"", 0)
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) for w in known}


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds licences in whole texts.

    A first pass counts the licence words' document frequencies, by which the index chooses its postings; a template
    counts where its key phrases and, in order, 70 % of its words stand. For each document: n_words, n_base (all places
    of base phrases), first_word and last_word (their smallest and largest start), base_labels and labels (with those of
    templates; sorted, comma-joined), score (1 for a base phrase, else the best share of a template's words found). A
    null or empty text has no words, null places, empty labels and score 0; a null doc_id is kept; repeated rows each
    give a row; ties of score give all labels; other columns are not read; an empty table gives no rows.
    """
    idf = licence_words(docs, id_col, text_col)

    def run(batches):
        index = RareWordIndex(PHRASES, TEMPLATES, idf)
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = []
                for value in part.column(1):
                    words = value.as_buffer().to_pybytes().translate(TO_WORDS).split() if value.is_valid else []
                    starts, scores, base = index.scan(words)
                    rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(scores))), max(scores.values(), default=0.0)))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return named(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir))
