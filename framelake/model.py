"""Data model: images as rows of planes, clips as rows of samples, and their long forms; inputs derived from tables.

image    image_id bigint, w int, h int, planes array<array<int>>  (row-major; L, LA, RGB or RGBA by the number of planes)
pixels   image_id, x, y and a column for each plane
clip     clip_id bigint, samples array<double>; long: clip_id, i, s
packet   source, pts, duration, is_keyframe, size
cue      track_id, idx, start, end, text
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def level(e: Column) -> Column:
    """A pixel value from an embedding component."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.lit(128.0) + F.lit(256.0) * e.cast("double")).cast("double"))).cast("int")


def images(df: DataFrame, w: int, h: int) -> DataFrame:
    return df.select("image_id", F.lit(w).alias("w"), F.lit(h).alias("h"), "planes")


def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 luma images, one for each vector."""
    df = table(spark, sf_dir, "embeddings")
    return images(df.select(F.col("vec_id").alias("image_id"), F.array(F.transform("embedding", level)).alias("planes")), 8, 8)


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 RGB images from three vectors in a row."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", level).alias("plane"))
    plane = lambda k: F.max(F.when(F.col("vec_id") % 3 == k, F.col("plane")))
    df = df.groupBy(F.floor(F.col("vec_id") / 3).alias("image_id")).agg(F.count(F.lit(1)).alias("n"), F.array(plane(0), plane(1), plane(2)).alias("planes"))
    return images(df.where("n = 3"), 8, 8)


def gray32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32x32 luma images from sixteen vectors in a row, each an 8x8 tile."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", level).alias("plane"))
    df = df.groupBy(F.floor(F.col("vec_id") / 16).alias("image_id")).agg(F.count(F.lit(1)).alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "plane"))), lambda t: t["plane"])).alias("flat"))
    tile = "transform(sequence(0, 1023), i -> flat[(i div 256 * 4 + i % 32 div 8) * 64 + i div 32 % 8 * 8 + i % 8])"
    return images(df.where("n = 16").select("image_id", F.array(F.expr(tile)).alias("planes")), 32, 32)


def pixels(df: DataFrame, *names: str) -> DataFrame:
    """The long form of images: one row for each pixel."""
    names = names or ("v",)
    rows = df.select("image_id", "w", "h", F.posexplode(F.arrays_zip(*(F.col("planes")[k].alias(n) for k, n in enumerate(names)))).alias("i", "p"))
    return rows.select("image_id", "w", "h", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), *(F.col("p")[n].alias(n) for n in names))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips in long form: the events of a user in order of time."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50.0) / 150.0))
    df = table(spark, sf_dir, "events")
    return df.select(F.col("user_id").alias("clip_id"), (F.row_number().over(w) - 1).cast("long").alias("i"), s.alias("s"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips in compact form."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50.0) / 150.0)).alias("s")
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", s)
    samples = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "s"))), lambda r: r["s"])
    return df.groupBy(F.col("user_id").alias("clip_id")).agg(samples.alias("samples"))


def samples(df: DataFrame, name: str = "samples") -> DataFrame:
    """The long form of clips."""
    return df.select("clip_id", F.posexplode(name).alias("i", "s")).select("clip_id", F.col("i").cast("long").alias("i"), "s")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of a source: pts in 1/90000 s, a keyframe every 12 packets."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    df = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), F.length("props").cast("long").alias("size"))
    return df.select(F.col("user_id").alias("source"), "i", (F.col("i") * 3003).alias("pts"), F.lit(3003).cast("long").alias("duration"), (F.col("i") % 12 == 0).alias("is_keyframe"), "size")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle cues: the turns of a conversation, as long as their texts at 15 characters a second."""
    n = F.length("text").cast("long")
    end = F.sum(n).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", end.alias("e"), n.alias("n"))
    return df.select(F.col("conv_id").alias("track_id"), (F.col("turn") + 1).alias("idx"), ((F.col("e") - F.col("n")) / F.lit(15.0)).alias("start"), (F.col("e") / F.lit(15.0)).alias("end"), "text")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: the lines of an order as square boxes with a score."""
    df = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 100
    return df.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("det_id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + F.col("l_quantity")).alias("y2"), F.col("l_extendedprice").alias("score"))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered frame sequence with gaps and some frames of another size."""
    df = table(spark, sf_dir, "orders").where(F.col("o_custkey") % 7 != 0)
    return df.select(F.col("o_orderkey").alias("frame_no"), F.when(F.col("o_custkey") % 3 == 0, 320).otherwise(640).alias("width"), F.when(F.col("o_custkey") % 3 == 0, 240).otherwise(480).alias("height"))


#: The same inputs for DuckDB, by name.
SQL = {
    "gray8": "gray8 AS (SELECT vec_id AS image_id, CAST((p - 1) % 8 AS INTEGER) AS x, CAST((p - 1) // 8 AS INTEGER) AS y, CAST(least(255, greatest(0, floor(128 + 256 * CAST(embedding[p] AS DOUBLE)))) AS INTEGER) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings))",
    "rgb8": "rgb8 AS (SELECT image_id // 3 AS image_id, x, y, max(v) FILTER (image_id % 3 = 0) AS r, max(v) FILTER (image_id % 3 = 1) AS g, max(v) FILTER (image_id % 3 = 2) AS b FROM gray8 GROUP BY image_id // 3, x, y HAVING count(*) = 3)",
    "gray32": "gray32 AS (SELECT image_id // 16 AS image_id, CAST(x + 8 * (image_id % 16 % 4) AS INTEGER) AS x, CAST(y + 8 * (image_id % 16 // 4) AS INTEGER) AS y, v FROM gray8 WHERE image_id // 16 IN (SELECT vec_id // 16 FROM embeddings GROUP BY 1 HAVING count(*) = 16))",
    "sig": "sig AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 150)) AS s FROM events)",
    "pkt": "pkt AS (SELECT user_id AS source, i, i * 3003 AS pts, 3003::BIGINT AS duration, i % 12 = 0 AS is_keyframe, size FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, length(props) AS size FROM events))",
    "cue": "cue AS (SELECT conv_id AS track_id, turn + 1 AS idx, (e - n) / 15.0::DOUBLE AS \"start\", e / 15.0::DOUBLE AS \"end\", text FROM (SELECT conv_id, turn, text, length(text) AS n, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e FROM conversations))",
    "det": "det AS (SELECT l_orderkey AS image_id, l_linenumber AS det_id, CAST(l_partkey % 100 AS DOUBLE) AS x1, CAST(l_suppkey % 100 AS DOUBLE) AS y1, l_partkey % 100 + l_quantity AS x2, l_suppkey % 100 + l_quantity AS y2, l_extendedprice AS score FROM lineitem)",
    "seq": "seq AS (SELECT o_orderkey AS frame_no, CASE WHEN o_custkey % 3 = 0 THEN 320 ELSE 640 END AS width, CASE WHEN o_custkey % 3 = 0 THEN 240 ELSE 480 END AS height FROM orders WHERE o_custkey % 7 <> 0)",
}
NEEDS = {"rgb8": ["gray8"], "gray32": ["gray8"]}


def with_inputs(sql: str) -> str:
    """A statement whose inputs are written {gray8} and so on, with their definitions in front."""
    names: list[str] = []
    for name in SQL:
        if f"{{{name}}}" in sql:
            names += [n for n in [*NEEDS.get(name, []), name] if n not in names]
    for name in names:
        sql = sql.replace(f"{{{name}}}", name)
    sql = sql.strip()
    if not names:
        return sql
    head = ", ".join(SQL[n] for n in names)
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"
