"""Query op4: benchmark passages in ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.llm.decontamination import LAST, find_contamination
from txnflow.llm.registry import register
from txnflow.llm.tables import read

SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[s + 1:s + least(len(ws), 10)], ' ') AS k
  FROM (SELECT item, ws, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (
  SELECT doc_id, size, s, array_to_string(ws[s + 1:s + size], ' ') AS k
  FROM (SELECT doc_id, ws, size, unnest(range(0, greatest(len(ws) - size + 1, 0))) AS s FROM d, sizes)),
occ AS (SELECT DISTINCT doc_id, pos.size, s, item FROM pos JOIN win USING (k, size)),
hit AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM occ) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register("op4_decontamination", SQL)
def op4(spark, sf_dir):
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; windows of ten words."""
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        F.when(F.col("oid") != LAST, F.col("oid")).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
