"""DuckDB SQL for the operators of this subpackage that SQL can express; whole tables, by plain definitions."""

from __future__ import annotations

#: Every pair that shares a shingle is counted exactly; components are the closure of the links.
NGRAM_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS k FROM links GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN least ON least.a = d.doc_id LEFT JOIN counted ON counted.a = d.doc_id
"""

#: Bytes as hexadecimal, two characters each; every window of 50 bytes is one row.
SUFFIX_DEDUP = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), f AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM w JOIN f USING (s) WHERE doc_id > first
), r AS (
  SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c
), spans AS (
  SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM r GROUP BY doc_id, k
), gaps AS (
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS after FROM spans
), cut AS (
  SELECT doc_id, sum(e - b) AS removed, count(*) AS k, max(e) AS last, string_agg(substring(h, 2 * after + 1, 2 * (b - after)), '' ORDER BY b) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
