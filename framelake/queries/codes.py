"""Barcodes and the capability report."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import codes
from ..plans import capabilities
from . import query

TEXT = "printf('%d:%s', page_id, url)"
BITS = f"(SELECT page_id, size, string_agg(printf('%08b', ascii(substr(t, k, 1))), '' ORDER BY k) AS bits FROM (SELECT page_id, t, 21 + (greatest(1, least(40, length(t) // 10)) - 1) * 4 AS size, unnest(range(1, length(t) + 1)) AS k FROM (SELECT page_id, {TEXT} AS t FROM pages)) GROUP BY 1, 2)"
FIND = "CASE WHEN {x} BETWEEN 0 AND 6 AND {y} BETWEEN 0 AND 6 THEN CAST({x} IN (0, 6) OR {y} IN (0, 6) OR ({x} BETWEEN 2 AND 4 AND {y} BETWEEN 2 AND 4) AS INTEGER) END"


@query("qr_matrix", f"""SELECT page_id, CAST(size AS INTEGER) AS size, CAST(sum(d) AS BIGINT) AS dark, md5(string_agg(CAST(d AS VARCHAR), '' ORDER BY y, x)) AS digest FROM (
SELECT page_id, size, x, y, coalesce(
  CASE WHEN x BETWEEN 8 AND size - 2 AND y BETWEEN 8 AND size - 9 THEN CAST(nullif(substr(bits, (x - 8) // 2 * 2 * (size - 16) + (y - 8) * 2 + (x - 8) % 2 + 1, 1), '') AS INTEGER) END,
  CASE WHEN x = 6 AND y BETWEEN 8 AND size - 9 THEN CAST(y % 2 = 0 AS INTEGER) WHEN y = 6 AND x BETWEEN 8 AND size - 9 THEN CAST(x % 2 = 0 AS INTEGER) END,
  {FIND.format(x='x', y='y')}, {FIND.format(x='(x - size + 7)', y='y')}, {FIND.format(x='x', y='(y - size + 7)')}, 0) AS d
FROM (SELECT page_id, size, bits, i % size AS x, i // size AS y FROM (SELECT *, unnest(range(size * size)) AS i FROM {BITS}))) GROUP BY page_id, size""")
def qr_matrix(spark, sf_dir):
    text = F.concat(F.col("page_id").cast("string"), F.lit(":"), "url")
    df = model.table(spark, sf_dir, "pages").select("page_id", codes.qr_size(text).alias("size"), codes.qr_matrix(text).alias("m"))
    return df.select("page_id", "size", F.aggregate("m", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("dark"), F.md5(F.array_join("m", "").cast("binary")).alias("digest"))


@query("code128_bits", f"SELECT o_orderkey, '110100100010' || string_agg(CASE c WHEN '0' THEN '11011001100' WHEN '1' THEN '11001101100' WHEN 'A' THEN '10100110010' ELSE '10101001100' END, '' ORDER BY k) || '1100011101011' AS bars FROM (SELECT o_orderkey, k, substr(t, k, 1) AS c FROM (SELECT o_orderkey, t, unnest(range(1, length(t) + 1)) AS k FROM (SELECT o_orderkey, o_orderkey || 'A' || o_custkey AS t FROM orders))) GROUP BY o_orderkey")
def code128_bits(spark, sf_dir):
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit("A"), F.col("o_custkey").cast("string"))
    return model.table(spark, sf_dir, "orders").select("o_orderkey", codes.code128(text).alias("bars"))


@query("capabilities")
def capability_report(spark, sf_dir):
    return capabilities.report(spark)
