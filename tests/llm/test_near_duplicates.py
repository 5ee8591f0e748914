import random
import re

from framelake.llm import graph
from framelake.llm import op08_minhash as op

from .fixtures import clashing, empty_docs, odd_docs, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) or rows[a][:2] == rows[b][:2]:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return [(r[0], len(sets[k]), least.get(root(k)), r[0] is None or r[0] == least[root(k)]) for k, r in enumerate(rows)]


def test_against_brute_force(spark):
    rng = random.Random(3)
    extra = []
    for size in (3, 5, 8, 12, 20, 60, 200, 600):
        base = words(rng, size).split()
        for change in range(6):
            copy = list(base)
            for _ in range(change):
                copy.insert(rng.randrange(len(copy) + 1), words(rng, 1))
            extra.append(" ".join(copy))
    chain = words(rng, 120).split()
    extra += [" ".join(chain[k : k + 80]) for k in range(0, 40, 5)]
    extra += ["One two", "one TWO", "one"]
    df, rows = odd_docs(spark, extra=extra)
    got = op.near_duplicates(clashing(df)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    unique = [r for k, r in enumerate(rows) if r[0] is not None and k != len(rows) - 2]
    rng.shuffle(unique)
    got = op.near_duplicates(spark.createDataFrame(unique, df.schema)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(unique)))
    assert op.near_duplicates(empty_docs(spark)).count() == 0


def test_strays_find_links_the_star_misses():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    base = words(rng, 130).split()
    texts = [words(rng, 130), " ".join(base), " ".join(base[:126])]
    sets = op.shingle_sets(pa.array(texts))
    signature = op.signatures(sets)
    band = int((op.band_keys(signature[1:2]) == op.band_keys(signature[2:3]))[0].argmax())
    signature[0, 4 * band : 4 * band + 4] = signature[1, 4 * band : 4 * band + 4]
    bucket = int(op.band_keys(signature[:1])[0, band])
    rows = pa.RecordBatch.from_arrays([pa.array([bucket] * 3), pa.array([0, 5, 9]), pa.array([0, 5, 9]), pa.array([len(s) for s in sets]), pa.array([np.ascontiguousarray(x).tobytes() for x in signature]), pa.array(texts)], list("abcdef"))
    assert [p.to_pylist() for p in op._strays([rows])] == [[{"a": 9, "b": 5}]]


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 10), (10, 2), (7, 7), (100, 99), (99, 98), (98, 97), (97, 96), (96, 1)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 2 for k in (2, 3, 4, 5, 10)}, 8: 8, 9: 8, **{k: 1 for k in (1, 96, 97, 98, 99, 100)}}
