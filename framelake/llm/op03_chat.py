"""Chat formatting by perspective rotation: each participant of a dialogue is the assistant of one rendering of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns whose offsets one window sums; longer conversations are summed block by block.
BLOCK = 256
SYSTEM = "system"


def rotate(turns: DataFrame) -> DataFrame:
    """One row for each message of each participant's rendering: conv_id, perspective, turn, segment, target, start, length.

    In perspective p the messages of p are the assistant's and are targets (the loss mask), system messages stay, all
    others are users named by their role. start is the segment's character offset in the rendering, length its
    characters; the rendering is the segments in order of start. A null role counts as "unknown", a null text as empty,
    a null turn as turn -1, null conv_id as one conversation of its own. Messages of one turn go by role and text, so
    repeated rows each keep a segment. A conversation of system messages alone has no participant and no row. Other columns
    are not read; an empty table gives no rows.
    """
    messages = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    speakers = messages.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    rows = messages.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    target = F.col("role") == F.col("perspective")
    rows = rows.select("conv_id", "perspective", "turn", "role", "text", target.alias("target"), segment(target).alias("segment"))
    rows = rows.withColumns({"length": F.length("segment").cast("long"), "block": F.floor(F.col("turn") / BLOCK)})
    keys = ["conv_id", "perspective"]
    before = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "block").agg(F.sum("length").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), "base")
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    inside = W.partitionBy(*keys, "block").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("length").over(inside), F.lit(0))
    return rows.select("conv_id", "perspective", "turn", "segment", "target", start.alias("start"), "length")


def segment(target: Column) -> Column:
    head = F.when(target, F.lit("<|assistant|>")).when(F.col("role") == SYSTEM, F.lit("<|system|>")).otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>")))
    return F.concat(head, F.lit("\n"), "text", F.lit("<|end|>\n"))


def renderings(segments: DataFrame) -> DataFrame:
    """Whole renderings of rotate(): text and the target spans, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "length", "target", "segment")))
    spans = F.transform(F.filter("parts", lambda p: p["target"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    grouped = segments.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    return grouped.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"), spans.alias("targets"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = """
WITH m AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
r AS (
  SELECT m.conv_id, perspective, turn, role, text, role = perspective AS target,
    CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END || chr(10) || text || '<|end|>' || chr(10) AS segment
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, perspective, turn, segment, target,
  CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(length(segment) AS BIGINT) AS length
FROM r
"""
