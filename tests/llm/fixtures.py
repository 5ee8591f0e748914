"""Small tables with the odd cases: nulls, empty and long texts, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "eau", "ch", "ng"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_docs(spark, n=60, seed=1, extra=()):
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(1, 400)) for _ in range(n)]
    texts += [texts[3], texts[3], "", None, "é́ ÎÇ 　x", "word " * 3000, "A\r\n\tB  c", *extra]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "row without an id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Columns named as those that the operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("g", "n", "path", "shard", "start", "length", "ids", "score", "words", "hub", "id", "key")})
