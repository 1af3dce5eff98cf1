"""SQL of the queries in staged.py, for DuckDB."""

from tributary.plans.tables_sql import _rate, _tok

_ORDERS = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderkey % 1000 AS order_number, CAST(o_custkey AS VARCHAR) AS customer_id, {_tok('email', "'user' || o_custkey || '@shop.example'")} AS email_token,
  CASE WHEN o_orderkey % 5 <> 0 THEN {_tok('phone', "'+1555' || lpad(CAST(o_custkey AS VARCHAR), 7, '0')")} END AS phone_token, CAST(o_totalprice AS DECIMAL(18,2)) AS total_price,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(1.5 AS DECIMAL(18,2)) END AS total_discounts, CAST(NULL AS DECIMAL(18,2)) AS total_tax, CAST(4.9 AS DECIMAL(18,2)) AS shipping_amount,
  CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS line_item_count, o_orderkey % 3 AS discount_count, o_orderkey % 3 > 0 AS has_discount, o_orderstatus = 'F' AND o_orderdate IS NOT NULL AS is_cancelled,
  upper(substr(o_orderpriority, 3, 2)) AS shipping_country_code, 'Bonn' AS shipping_city, epoch_us(date_trunc('second', o_orderdate)) AS created_us, CAST(NULL AS BIGINT) AS updated_us FROM orders"""
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_MONEY = f"CAST(CAST({_CENTS} AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2))"
_CHARGES = f"""
SELECT 'ch_' || l_orderkey || '_' || l_linenumber AS charge_id, 'cus_' || l_suppkey AS customer_id, {_MONEY} AS amount, CASE WHEN l_linestatus = 'O' THEN {_MONEY} ELSE 0 END AS amount_captured,
  CASE WHEN l_returnflag = 'R' THEN {_MONEY} ELSE 0 END AS amount_refunded, CAST(NULL AS DECIMAL(18,2)) AS application_fee_amount, 'USD' AS currency, CASE l_suppkey % 3 WHEN 0 THEN 'visa' WHEN 1 THEN 'amex' ELSE 'jcb' END AS card_brand,
  lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') AS card_last4, l_suppkey % 12 + 1 AS card_exp_month, 'DE' AS card_country, {_tok('email', "'pay' || l_suppkey || '@x.example'")} AS email_token, l_linenumber AS risk_score,
  l_returnflag = 'R' AND {_CENTS} > 0 AS is_refunded, epoch_us(date_trunc('second', l_shipdate)) AS created_us FROM lineitem"""
_FIRST = "CASE c_custkey % 4 WHEN 0 THEN 'Cher' WHEN 1 THEN 'Ann' WHEN 3 THEN 'Jo' END"
_LAST = "CASE c_custkey % 4 WHEN 1 THEN 'Lee' || c_custkey WHEN 3 THEN 'van Dyk' || c_custkey END"
_FULL = "CASE c_custkey % 4 WHEN 0 THEN 'Cher' WHEN 1 THEN 'Ann  Lee' || c_custkey WHEN 3 THEN 'Jo van Dyk' || c_custkey END"
_low = lambda kind, e: f"CASE WHEN {e} IS NOT NULL THEN {_tok(kind, f'lower({e})')} END"
_STRIPE_CUSTOMERS = f"""
SELECT 'cus_' || c_custkey AS customer_id, CASE WHEN c_custkey % 3 <> 0 THEN {_tok('email', "'c' || c_custkey || '@y.example'")} END AS email_token, {_low('name', _FIRST)} AS first_name_token, {_low('name', _LAST)} AS last_name_token,
  {_low('name', _FULL)} AS full_name_token, CAST(NULL AS VARCHAR) AS phone_token, {_tok('address', "'1 high st'")} AS address_line1_token, c_mktsegment AS city, CAST(c_custkey % 100 AS VARCHAR) AS postal_code, 'GB' AS country,
  CAST(CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2)) AS balance, c_custkey * 86400000000 AS created_us FROM customer"""
_MAIL = "'h' || c_custkey || '@hub.example'"
_CONTACTS = f"""
SELECT CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey + 1000000 AS VARCHAR) END AS contact_id, CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 2 = 0 THEN {_tok('email', _MAIL)} END AS email_token,
  {_tok('name', "'ada'")} AS first_name_token, {_tok('name', 'lower(trim(c_name))')} AS last_name_token, {_tok('name', "'ada ' || lower(trim(c_name))")} AS full_name_token,
  CASE WHEN c_custkey % 2 = 0 THEN {_tok('phone', "'0039061234567'")} END AS mobile_phone_token, CASE WHEN c_custkey % 2 = 0 THEN 'Rome' END AS city, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS company,
  CASE WHEN c_custkey % 2 = 0 THEN epoch_us(TIMESTAMP '2024-02-03 04:05:06') END AS created_us FROM customer WHERE c_custkey % 35 <> 0"""
_CAMPAIGNS = """
SELECT 'c' || (p_partkey % 50) || '-' || p_partkey AS campaign_id, 'regular' AS campaign_type, p_name AS subject, p_brand AS from_name, p_size AS emails_sent, CASE WHEN p_partkey % 2 = 0 THEN CAST(0.25 AS DECIMAL(5,4)) END AS open_rate,
  CAST(0.031 AS DECIMAL(5,4)) AS click_rate, epoch_us(TIMESTAMP '2024-05-06 07:08:09') AS send_time_us FROM part"""
_ACTION = "CASE WHEN event_type = 'error' THEN 'bounce' ELSE lower(event_type) END"
_EMAIL_EVENTS = f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, 'c' || (user_id % 50) AS campaign_id, {_tok('email', "'u' || user_id || '@x.example'")} AS email_token, {_ACTION} AS action, CAST(ts AS DATE) AS event_date, 'FR' AS country_code,
  event_type = 'error' AS is_bounce, epoch_us(date_trunc('second', ts)) AS event_us FROM events"""
_GA4 = f"""
SELECT DISTINCT 'cl' || user_id AS client_id, CASE WHEN user_id % 2 = 0 THEN {_tok('email', "'u' || user_id || '@x.example'")} END AS user_id_token, event_type AS event_name, CAST(ts AS DATE) AS event_date,
  CASE WHEN event_type = 'error' THEN '(direct)' ELSE 'google' END AS source, CASE event_type WHEN 'view' THEN 'organic' WHEN 'click' THEN 'cpc' WHEN 'signup' THEN 'email' ELSE 'other' END AS medium,
  CASE event_type WHEN 'error' THEN 'direct' WHEN 'view' THEN 'organic_search' WHEN 'click' THEN 'paid_search' WHEN 'signup' THEN 'email' ELSE 'other' END AS channel_group, 'mobile' AS device_category, 'Firefox' AS browser, 'Chile' AS geo_country,
  '/p/' || (user_id % 7) AS page_location, epoch_us(ts) AS event_us FROM events"""

ORACLE = {
    "staged_orders": _ORDERS,
    "stream_staged_orders": _ORDERS,
    "staged_charges": _CHARGES,
    "staged_stripe_customers": _STRIPE_CUSTOMERS,
    "staged_contacts": _CONTACTS,
    "staged_campaigns": _CAMPAIGNS,
    "staged_email_events": _EMAIL_EVENTS,
    "staged_ga4_events": _GA4,
    "charges_per_customer": f"""SELECT customer_id, sum(n) AS charges, CAST(sum(a) AS DECIMAL(18,2)) AS amount, {_rate('sum(r)', 'sum(n)')} AS refund_rate, arg_min(card_brand, (-n, card_brand)) AS preferred_card, max(l) AS last_charge_us
FROM (SELECT customer_id, card_brand, count(*) AS n, sum(amount) AS a, count(*) FILTER (WHERE is_refunded) AS r, max(created_us) AS l FROM ({_CHARGES}) GROUP BY 1, 2) GROUP BY 1""",
    "subscriber_actions": "SELECT email_token, " + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}s" for a in ("view", "click", "signup", "purchase", "bounce")) + ", " + ", ".join(f"max(event_date) FILTER (WHERE action = '{a}') AS last_{a}" for a in ("view", "click")) + f" FROM ({_EMAIL_EVENTS}) GROUP BY 1",
    "user_behaviour": "SELECT user_id, count(*) AS events, round(sum(value), 2) AS value, CAST(max(ts) AS DATE) AS last_seen, " + ", ".join(f"round(avg((coalesce(event_type, '') = '{k}')::INT), 6) AS {k}_share" for k in ("view", "purchase")) + " FROM events GROUP BY 1",
    "payments_daily": f"SELECT CAST(make_timestamp(created_us) AS DATE) AS payment_date, count(*) AS charges, count(*) FILTER (WHERE amount_captured > 0) AS captured, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, {_rate('count(*) FILTER (WHERE amount_captured > 0)', 'count(*)')} AS captured_rate FROM ({_CHARGES}) GROUP BY 1",
    "campaign_performance": f"""SELECT *, {_rate('clicks', 'views')} AS click_rate, {_rate('bounces', 'emails_sent')} AS bounce_rate FROM (SELECT campaign_id, g.emails_sent, coalesce(views, 0) AS views, coalesce(clicks, 0) AS clicks, coalesce(bounces, 0) AS bounces
FROM (SELECT split_part(campaign_id, '-', 1) AS campaign_id, sum(emails_sent) AS emails_sent FROM ({_CAMPAIGNS}) GROUP BY 1) g LEFT JOIN (SELECT campaign_id, """ + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}s" for a in ("view", "click", "bounce")) + f" FROM ({_EMAIL_EVENTS}) GROUP BY 1) USING (campaign_id))",
}
