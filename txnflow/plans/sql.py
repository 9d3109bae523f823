"""The test-data derivations and shared pipeline stages as SQL common table expressions.

``with_ctes(names, body)`` stitches the named CTEs (in dependency order) in
front of a final SELECT.  The SQL is plain ANSI plus a few DuckDB spellings
(``json_extract_string``, ``epoch``, ``strftime``, ``list``) and runs on the raw
test tables registered as views.
"""

from __future__ import annotations

CTE: dict[str, str] = {}

CTE["journey_event"] = """
SELECT CAST(e.user_id AS VARCHAR) AS actor_id,
  CASE e.event_type WHEN 'click' THEN 'mybank_transaction' WHEN 'view' THEN 'myatm_transaction'
       WHEN 'purchase' THEN 'atm_transaction' WHEN 'signup' THEN 'browse' ELSE e.event_type END AS event,
  CAST(yearweek(e.ts) AS VARCHAR) AS yyyymm,
  CASE WHEN e.event_id % 5 = 0 THEN 'others' ELSE 'self' END AS action_sponsor,
  CAST(floor(epoch(e.ts)) AS BIGINT) AS action_time,
  CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE p.p_type END AS action_type,
  CAST(e.user_id AS VARCHAR) AS object_id,
  CAST(json_object(
    'action', json_object('twd_amt', CAST(floor(e.value) * 10 AS DOUBLE),
                          'txn_currency_code', CASE WHEN e.k % 10 = 0 THEN 'USD' WHEN e.k % 10 = 1 THEN NULL ELSE 'TWD' END,
                          'txn_type_desc', CASE WHEN e.event_id % 13 = 0 THEN NULL ELSE p.p_name END),
    'channel', json_object('atm_location', CASE WHEN e.event_type IN ('purchase', 'view') AND e.k % 4 <> 3
                                                THEN concat_ws(' ', p.p_brand, p.p_name) END),
    'object', json_object('target_acct_nbr', CASE WHEN e.event_type = 'click' AND e.event_id % 7 = 0 THEN NULL
                                                  ELSE CAST(e.k AS VARCHAR) END,
                          'target_bank_code', CASE WHEN e.k < 40 THEN '013' WHEN e.k >= 90 THEN NULL ELSE '812' END)
  ) AS VARCHAR) AS attrs
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
LEFT JOIN part p ON p.p_partkey = e.k
"""

CTE["journey"] = """
SELECT DISTINCT actor_id, event, yyyymm AS behavior_yyyymm, action_sponsor, action_time, action_type, object_id,
  TRY_CAST(json_extract_string(attrs, '$.action.twd_amt') AS DOUBLE) AS twd_amt,
  json_extract_string(attrs, '$.action.txn_currency_code') AS txn_currency_code,
  json_extract_string(attrs, '$.action.txn_type_desc') AS txn_type_desc,
  json_extract_string(attrs, '$.channel.atm_location') AS atm_location,
  json_extract_string(attrs, '$.object.target_acct_nbr') AS target_acct_nbr,
  json_extract_string(attrs, '$.object.target_bank_code') AS target_bank_code
FROM journey_event
WHERE event IN ('atm_transaction', 'myatm_transaction', 'mybank_transaction')
  AND yyyymm BETWEEN '202402' AND '202404'
"""

CTE["accounts"] = """
SELECT DISTINCT
  CAST(CASE WHEN c_custkey BETWEEN 50 AND 99 THEN c_custkey - 50 ELSE c_custkey END AS VARCHAR) AS customer_id,
  CAST(c_custkey AS VARCHAR) AS acct_nbr,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'C' ELSE 'I' END AS customer_class_code,
  CASE WHEN c_custkey % 20 = 13 THEN '202403' ELSE '202402' END AS yyyymm,
  printf('%d%02d', 2010 + c_custkey % 10, 1 + c_custkey % 12) AS start_ym,
  CAST(CASE WHEN c_custkey % 10 <= 5 THEN 0 WHEN c_custkey % 10 = 6 THEN 1
            WHEN c_custkey % 10 <= 8 THEN 2 ELSE 3 END AS INTEGER) AS label
FROM customer
"""

CTE["joined"] = """
SELECT j.*, a.customer_id, a.acct_nbr, a.customer_class_code, a.yyyymm, a.start_ym, a.label,
       t.customer_id AS target_customer_id
FROM journey j
JOIN (SELECT * FROM accounts WHERE yyyymm = '202402') a ON j.object_id = a.acct_nbr
LEFT JOIN (SELECT * FROM accounts WHERE yyyymm = '202402') t ON j.target_acct_nbr = t.acct_nbr
"""


def with_ctes(names, body: str) -> str:
    parts = [f"{n} AS ({CTE[n].strip()})" for n in names]
    return ("WITH " + ",\n".join(parts) + "\n" + body.strip()) if parts else body.strip()


BASE = ["journey_event", "journey", "accounts", "joined"]


def _domain_ctes():
    from txnflow.domain import TESTDATA_DOMAIN as d
    from txnflow.plans import sqlgen as g
    CTE["cleaned"] = f"""
SELECT actor_id, event, behavior_yyyymm, action_sponsor, action_time,
  coalesce(action_type, 'unknown') AS action_type, object_id, twd_amt,
  coalesce(txn_currency_code, 'unknown') AS txn_currency_code,
  coalesce(txn_type_desc, 'unknown') AS txn_type_desc,
  coalesce(CASE WHEN atm_location IS NULL AND event IS DISTINCT FROM {g.lit(d.atm_event)}
                THEN {g.lit(d.online_location)} ELSE atm_location END, 'unknown') AS atm_location,
  coalesce(target_acct_nbr, 'unknown') AS target_acct_nbr,
  coalesce(target_bank_code, 'unknown') AS target_bank_code,
  customer_id, acct_nbr, customer_class_code, yyyymm, start_ym, label,
  coalesce(target_customer_id, 'unknown') AS target_customer_id
FROM joined
WHERE event IS DISTINCT FROM {g.lit(d.excluded_event)} AND label IS DISTINCT FROM 3
  AND customer_class_code = 'I' AND action_sponsor = 'self'
"""
    CTE["features0"] = f"""
SELECT *, make_timestamp(action_time * 1000000) AS ts_utc,
  replace(atm_location, {g.lit(d.location_dash)}, ' ') AS loc_text,
  action_type || ' ' || txn_type_desc AS all_action_types
FROM cleaned
"""
    CTE["features1"] = f"""
SELECT actor_id, event, behavior_yyyymm, action_sponsor, action_type, object_id, twd_amt, txn_currency_code,
  txn_type_desc, atm_location, target_acct_nbr, target_bank_code, customer_id, acct_nbr, customer_class_code,
  yyyymm, start_ym, label, target_customer_id,
  CASE WHEN coalesce(target_bank_code <> {g.lit(d.home_bank_code)}, TRUE) THEN 1 ELSE 0 END AS isCrossBank,
  CASE WHEN coalesce(actor_id = target_customer_id, FALSE) AND coalesce(acct_nbr <> target_acct_nbr, TRUE)
       THEN 1 ELSE 0 END AS isSelfTrans,
  CASE WHEN coalesce(txn_currency_code IN {g.in_list(d.home_currencies)}, FALSE) THEN 0 ELSE 1 END AS isExchangeDeal,
  CAST(month(ts_utc) AS INTEGER) AS action_time_month,
  CAST(day(ts_utc) AS INTEGER) AS action_time_day,
  CAST(hour(ts_utc) AS INTEGER) AS action_time_hour,
  CAST(isodow(ts_utc) AS INTEGER) AS action_time_dayOfWeek,
  action_time AS action_epoch,
  action_time / 86400.0 AS action_time,
  CASE WHEN isodow(ts_utc) IN (6, 7) THEN 1 ELSE 0 END AS action_time_isWeekend_1,
  CASE WHEN hour(ts_utc) >= 7 AND hour(ts_utc) < 13 THEN 1 ELSE 0 END AS action_time_periodOfDay_1,
  CASE WHEN hour(ts_utc) >= 13 AND hour(ts_utc) < 19 THEN 1 ELSE 0 END AS action_time_periodOfDay_2,
  CASE WHEN NOT (hour(ts_utc) >= 1 AND hour(ts_utc) < 19) THEN 1 ELSE 0 END AS action_time_periodOfDay_3,
  CASE WHEN event = 'atm_transaction' THEN 1 ELSE 0 END AS event_atm_transaction,
  CASE WHEN event = 'myatm_transaction' THEN 1 ELSE 0 END AS event_myatm_transaction,
  {g.classify('loc_text', d.location_rules, d.location_default)} AS cat_location,
  {g.location_document('atm_location', d)} AS location_doc,
  all_action_types,
  {g.classify('all_action_types', d.action_rules, d.action_default, 'twd_amt')} AS cat_action
FROM features0
"""
    CTE["features2"] = f"""
SELECT *,
  CASE WHEN action_sponsor = 'self' AND coalesce(twd_amt = 0, FALSE)
            AND coalesce(regexp_matches(cat_action, {g.lit(d.enquiry_category_pattern)}), FALSE) THEN 0
       WHEN action_sponsor = 'self' AND coalesce(twd_amt > 0, FALSE)
            AND coalesce(regexp_matches(all_action_types, {g.lit(d.cash_out_pattern)}), FALSE)
            AND NOT coalesce(regexp_matches(all_action_types, {g.lit(d.cash_out_exclude)}), FALSE) THEN -1
       ELSE 1 END AS cash_flow
FROM features1
"""
    CTE["features"] = """
SELECT *, CASE WHEN cash_flow = -1 THEN 1 ELSE 0 END AS "cash_flow_-1",
  CASE WHEN cash_flow = 1 THEN 1 ELSE 0 END AS cash_flow_1
FROM features2
"""


_domain_ctes()
FEATURES = BASE + ["cleaned", "features0", "features1", "features2", "features"]
