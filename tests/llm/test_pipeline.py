import math
import random
import re

import corpus_pipeline
import numpy as np
import pytest

from framelake.llm import op02_packing, op06_secrets, op09_decontaminate

from .fixtures import words
from .test_models import lang_rows
from .test_simple_ops import crc, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def odd_rows():
    """Labelled texts, near and exact copies, benchmark passages, secrets, nulls, empties, a long text and repeated rows."""
    rng = random.Random(41)
    rows = [(i, t, l, s, n) for i, t, l, s, n in lang_rows(40)]
    item = words(rng, 30)
    long = " ".join(words(rng, 1) + str(k) for k in range(9000))
    near = rows[3][1].split()
    texts = [item, "a b " + item.upper() + " c", " ".join(item.split()[:14]), long, long + " more", f'token = "{KEY}" in ' + words(rng, 20), "", None, " ", "1234 5678", "é" * 30, "word", "word", rows[3][1], " ".join(near + ["tail"])]
    rows += [(100 + k, t, None if k % 2 else "xx", None, None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[45], rows[45], (None, texts[3], "xx", "s", 1), (None, None, None, None, None), (None, "only here and nowhere else but here", None, None, None)]
    return rows, [(1, item), (2, words(rng, 8)), (3, None), (None, "x y z"), (4, "a b")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows, bench = odd_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def told(rows):
    return sorted(repr(tuple(r)) for r in rows)


def near_groups(rows):
    """Row numbers of each group of near-duplicates, by comparing all pairs; rows without words are not in any."""
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                group[root(a)] = root(b)
    out = {}
    for k in range(len(rows)):
        if sets[k]:
            out.setdefault(root(k), []).append(k)
    return list(out.values())


def leaks(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    d = split(text)
    for i, item in items:
        b = split(item)
        if i is not None and len(b) >= 5:
            for shift in range(-len(b) + 1, len(d)):
                a, e = max(0, -shift), min(len(b), len(d) - shift)
                s, t, n = op09_decontaminate.best_run(np.array([b[j] == d[shift + j] for j in range(a, e)], bool))
                if n >= min(10, math.ceil(0.8 * len(b))) and n >= 0.7 * (t - s):
                    return True
    return False


def test_each_stage_against_brute_force(spark, odd):
    folder, rows, bench = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.language_id(spark, docs, folder).collect()
    assert told(got) == told(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))

    got = told(corpus_pipeline.near_duplicates(spark, docs, folder).collect())
    groups = near_groups(rows)
    inside = {k for g in groups for k in g}
    for k in range(len(rows)):
        if k not in inside:
            assert repr(rows[k]) in got
    heads = [min(((rows[k][0] is None, rows[k][0] or 0) for k in g)) for g in groups]
    assert len(got) == len(groups) + len(rows) - len(inside) and len(groups) < len(inside)
    for g, (nameless, head) in zip(groups, heads):
        kept = [x for k in g for x in [repr(rows[k])] if x in got]
        assert kept and (nameless or any(x.startswith(f"({head},") for x in kept))

    got = corpus_pipeline.decontamination(spark, docs, folder).collect()
    assert told(got) == told(r for r in rows if not leaks(r[1], bench)) and len(got) < len(rows)

    forest, want = op06_secrets.default_forest(), []
    for i, text, *rest in rows:
        found = [(a, b) for a, b, score in op06_secrets.scan_text(text or "", forest) if score >= 0.5]
        for a, b in reversed(op06_secrets.joined(found)):
            text = text[:a] + "[SECRET]" + text[b:]
        want.append((i, text, *rest[:2], len(text) if found else rest[2]))
    got = corpus_pipeline.secret_scan(spark, docs, folder).collect()
    assert told(got) == told(want) and not any(KEY in (r.text or "") for r in got) and any("[SECRET]" in (r.text or "") for r in got)

    pieces = corpus_pipeline.packing(spark, docs, folder).collect()
    path, want = op02_packing.vocabulary("word_bpe_49k.json"), []
    for i, text, *_ in rows:
        ids = tokens(path, text, 1)
        want += [(i, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048]), len(ids)) for k in range(0, len(ids), 2048)]
    assert told(tuple(p)[:5] for p in pieces) == told(want)
    places = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_stages_on_an_empty_table_and_other_columns(spark, odd):
    folder, rows, _ = odd
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    wide = spark.createDataFrame([(*r, "a", "b", 3) for r in rows], SCHEMA + ", component_id string, item_id string, g int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, folder)
        assert name == "packing" or out.columns == wide.columns
        assert out.count() > 40


def test_run_is_the_stages_in_a_row_and_leaves_one_folder(spark, odd):
    from pathlib import Path
    from urllib.parse import urlparse

    from framelake.llm.common import shared_dir

    folder, _, _ = odd
    place = Path(urlparse(shared_dir(spark)).path)
    before = {p.name for p in place.glob("framelake-*")}
    got = corpus_pipeline.run(spark, folder).collect()
    assert len({p.name for p in place.glob("framelake-*")} - before) == 1
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
    cut = lambda r: tuple(r)[:5]
    assert told(map(cut, got)) == told(map(cut, docs.collect()))


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    rows = lang_rows(120)
    item = words(rng, 40)
    rows += [(500, item, "xx", "s", 0), (501, "x " + item + " y", "xx", "s", 0), (502, rows[5][1], "xx", "s", 0), (503, f'bra ket token = "{"24be6443" * 5}" lom', "xx", "s", 55)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    every = {r[0] for r in rows}
    assert every - ids["language_id"] == {120, 121, 122}
    assert ids["language_id"] - ids["near_duplicates"] >= {502} and 5 in ids["near_duplicates"]
    assert ids["near_duplicates"] - ids["decontamination"] == {500, 501} & ids["near_duplicates"]
    assert ids["secret_scan"] == ids["decontamination"] == ids["packing"]
    assert any("[SECRET]" in r.text for r in seen["secret_scan"]) and not any("24be6443" in r.text for r in seen["secret_scan"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_one_document_of_each_group_without_good_ids(spark):
    rng = random.Random(16)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(7, a), (7, a), (3, a + " end"), (None, a), (None, b), (None, b), (None, b + " end"), (4, c), (4, d), (None, d), (9, ""), (9, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted((x for x in got if x[1] not in (b, b + " end")), key=repr) == sorted([(3, a + " end"), (4, c), (4, d), *rows[10:]], key=repr)
    assert len(got) == 8 and len([x for x in got if x[1] in (b, b + " end")]) == 1
