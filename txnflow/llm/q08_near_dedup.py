"""Query op8: near-duplicate groups of ``documents``."""

from __future__ import annotations

from txnflow.llm.near_dedup import near_duplicates
from txnflow.llm.registry import register
from txnflow.llm.tables import read

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY ALL),
e AS (SELECT rep, unnest(sh) AS g, len(sh) AS n FROM c),
inter AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
link AS (SELECT a, b FROM inter WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT rep AS node, rep AS seen FROM c
  UNION
  SELECT node, b FROM reach JOIN both_ways ON seen = a),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
       coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN comp ON comp.node = c.rep
"""


@register("op8_near_dedup", SQL)
def op8(spark, sf_dir):
    """Per document: doc_id, n_shingles, component_id, kept; two-word shingles, similarity of at least 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)
