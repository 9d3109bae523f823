"""Query op2: repeated 20-word passages of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.llm.registry import register
from txnflow.llm.substring_dedup import dedup_substrings
from txnflow.llm.tables import read

SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 19, 0))) AS s FROM w),
seq AS (
  SELECT doc_id, s, array_to_string(ws[s + 1:s + 20], ' ') AS k FROM win),
rep AS (
  SELECT doc_id, s FROM seq QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
hit AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM rep),
words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@register("op2_substring_dedup", SQL)
def op2(spark, sf_dir):
    """Per document: doc_id, n_words, n_removed, kept_sha256; windows of 20 words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, window=20).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
