"""Query op3: allow and block rules over the URLs of ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.llm.registry import register
from txnflow.llm.tables import read
from txnflow.llm.url_rules import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT host, path, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(rv, len(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (host, path)
"""


@register("op3_url_rules", SQL)
def op3(spark, sf_dir):
    """Per page: page_id, host, path, rule, verdict; a URL that no rule fits is allowed."""
    rules = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])))
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules) \
        .select("page_id", "host", "path", "rule", "verdict")
