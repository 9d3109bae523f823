"""Entry 3 queries: focus customers and favourite merchant per customer and weekday."""

from __future__ import annotations

from txnflow.operators.preference import focus_customers, merchant_preference
from txnflow.plans.registry import register
from txnflow.plans.sql import CTE, with_ctes
from txnflow.sources import testdata as td

FOCUS_WEEKS, PROFILE_WEEKS, MIN_COUNT = (1, 52), (0, 52), 10

CTE["consumption"] = """
SELECT CAST(o.o_custkey AS VARCHAR) AS customer_id,
  CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) / 7) AS INTEGER) AS week,
  CAST(dayofweek(o.o_orderdate) + 1 AS INTEGER) AS dayofweek,
  p.p_type AS consumption_category_desc,
  CASE WHEN n.n_nationkey = 0 THEN NULL ELSE n.n_name END AS loc_type_town,
  s.s_name AS merchant_name,
  CASE WHEN l.l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS merchant_flag,
  l.l_extendedprice AS txn_amt
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
"""
CTE["focus"] = f"""
SELECT customer_id, count(*) AS consumpt_cnt FROM consumption
WHERE week BETWEEN {FOCUS_WEEKS[0]} AND {FOCUS_WEEKS[1]} AND loc_type_town IS NOT NULL
GROUP BY customer_id HAVING count(*) >= {MIN_COUNT}
"""
_SPEND = "count(*) AS cnt, sum(CAST(txn_amt AS DECIMAL(18, 2))) AS amt"
CTE["pref"] = f"""
WITH base AS (SELECT * FROM consumption WHERE merchant_flag = 'Y' AND loc_type_town IS NOT NULL
                AND week BETWEEN {PROFILE_WEEKS[0]} AND {PROFILE_WEEKS[1]}),
intent AS (SELECT customer_id, dayofweek, consumption_category_desc, loc_type_town FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, dayofweek
                               ORDER BY cnt DESC, amt DESC, consumption_category_desc, loc_type_town) AS rk
  FROM (SELECT customer_id, dayofweek, consumption_category_desc, loc_type_town, {_SPEND}
        FROM base GROUP BY 1, 2, 3, 4) a) b WHERE rk = 1),
merchant AS (
  SELECT customer_id, consumption_category_desc, loc_type_town, merchant_name,
    row_number() OVER (PARTITION BY customer_id, consumption_category_desc
                       ORDER BY cnt DESC, amt DESC, loc_type_town, merchant_name) AS train_consum_cnt_rk
  FROM (SELECT customer_id, consumption_category_desc, loc_type_town, merchant_name, {_SPEND}
        FROM base GROUP BY 1, 2, 3, 4) c),
ranked AS (
  SELECT i.customer_id, i.consumption_category_desc, i.loc_type_town, i.dayofweek, m.merchant_name,
    row_number() OVER (PARTITION BY i.customer_id, i.consumption_category_desc, i.loc_type_town, i.dayofweek
                       ORDER BY m.train_consum_cnt_rk ASC NULLS LAST, m.merchant_name ASC NULLS LAST)
      AS train_output_rk
  FROM intent i LEFT JOIN merchant m
    ON i.customer_id = m.customer_id AND i.consumption_category_desc = m.consumption_category_desc
   AND i.loc_type_town = m.loc_type_town)
SELECT customer_id, consumption_category_desc, loc_type_town, dayofweek, merchant_name,
  CAST(train_output_rk AS INTEGER) AS train_output_rk
FROM ranked WHERE train_output_rk = 1 AND customer_id IN (SELECT customer_id FROM focus)
"""


def consumption(spark, sf_dir):
    return td.consumption(spark, sf_dir, (min(FOCUS_WEEKS[0], PROFILE_WEEKS[0]), max(FOCUS_WEEKS[1], PROFILE_WEEKS[1])))


@register("focus_customers", sql=with_ctes(["consumption", "focus"], "SELECT * FROM focus"))
def q_focus_customers(spark, sf_dir):
    return focus_customers(consumption(spark, sf_dir), FOCUS_WEEKS, MIN_COUNT)


@register("merchant_preference", bench=True, sql=with_ctes(["consumption", "focus", "pref"], "SELECT * FROM pref"))
def q_merchant_preference(spark, sf_dir):
    return merchant_preference(consumption(spark, sf_dir), FOCUS_WEEKS, PROFILE_WEEKS, MIN_COUNT)
