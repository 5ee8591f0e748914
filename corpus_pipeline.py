"""The training-corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's result to
the shared folder and reads it again, so that a lost executor costs at most one stage. A result that the next stage has
read is deleted; the last one stays, as the returned plan reads it.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and columns with any other
names, which they pass on untouched; what each does with a null or empty text is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import common, op02_packing, op04_langid, op06_secrets, op08_minhash, op09_decontaminate


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those with a null or empty text or without a letter go. Null doc_ids and repeats stay."""
    common.tune(spark)
    return op04_langid.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id (those without one come last).

    Rows of one doc_id, or without one, are told apart by their texts; of equal ones with words, one is kept. Null and
    empty texts and others without words are near nothing and all stay.
    """
    common.tune(spark)
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not odd.limit(1).count():
        kept = op08_minhash.near_duplicates(docs).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    rows = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = op08_minhash.near_duplicates(rows.select("__key", "text").distinct(), "__key").select(F.col("doc_id").alias("__key"), "component_id", "n_shingles")
    ids = rows.select("__key", "doc_id").distinct().join(found, "__key")
    least = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("r"), F.max("n_shingles").alias("n"))
    kept = common.cut(least.select(F.col("r.__key").alias("__key"), "n"))
    some = rows.join(kept.where("n > 0"), "__key", "left_semi").dropDuplicates(["__key"])
    wordless = rows.join(kept.where("n = 0"), "__key", "left_semi")
    return some.select(*docs.columns).unionAll(wordless.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark; null and empty texts share none."""
    common.tune(spark)
    return op09_decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; null and empty texts have none."""
    common.tune(spark)
    return op06_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is one piece, its end id."""
    common.tune(spark)
    return op02_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
