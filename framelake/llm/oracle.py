"""SQL for DuckDB of those corpus queries that SQL can express on whole tables."""

from __future__ import annotations

import string

#: Op 8: shingle sets, links by shared shingles, and the closure of the links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
c AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT c.id, p.b FROM c JOIN p ON p.a = c.other)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN (SELECT id, min(other) AS component_id FROM c GROUP BY id) m ON m.id = s.doc_id
"""

#: Op 7: all windows of 200 bytes by digest, merged runs, and what stands between them; two hex digits are a byte.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, -1) THEN 1 ELSE 0 END AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY doc_id, run),
kept AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS first, a AS last FROM s UNION ALL SELECT doc_id, max(b), max(b), 1000000000 FROM s GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(substr(h, 2 * first + 1, 2 * (last - first)), '' ORDER BY a) AS h FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t.h, d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""
