"""Query op12: how five filters interact on ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.llm.filter_audit import audit_masks, count_masks
from txnflow.llm.registry import register
from txnflow.llm.tables import read

LETTERS = "ABCDE"


def failing():
    """The conditions of filters A to D on ``text``; E, the repeated text, is the operator's own."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return [F.size(words) < 200,
            100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text"),
            F.col("text").rlike(r"[#$%&*|]")]


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(least < w.doc_id, w.doc_id IS NULL AND least IS NOT NULL) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
hit AS (
  SELECT part, filter_order, n, good, toxic, a, b, c, d, e,
    least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 9 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 9 END,
          CASE WHEN c THEN strpos(filter_order, 'C') ELSE 9 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 9 END,
          CASE WHEN e THEN strpos(filter_order, 'E') ELSE 9 END) AS gone
  FROM g, o),
st AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, hit.* EXCLUDE (part, filter_order),
    CASE filter_order[step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
    CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS many
  FROM hit, (SELECT unnest(range(1, 6)) AS step) s),
agg AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM st GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM agg
"""


@register("op12_filter_audit", SQL)
def op12(spark, sf_dir):
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = count_masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), failing())
    return audit_masks(counts, LETTERS)
