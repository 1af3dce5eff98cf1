"""SQL of the queries in tables.py, for DuckDB."""

_D = "CAST({} AS DECIMAL(18,2))"
_P = "CAST(o_totalprice AS DECIMAL(18,2))"


def _rate(a: str, b: str, digits: int = 4) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {digits}) + 0.0"


def _numbered(gap: int) -> str:
    return f"""
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess_num FROM (
  SELECT *, CASE WHEN prev IS NULL OR date_diff('second', date_trunc('second', prev), date_trunc('second', ts)) > {gap} THEN 1 ELSE 0 END AS new FROM (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL))"""


def _sessions(gap: int) -> str:
    return f"""
SELECT *, views >= 2 OR purchases > 0 AS is_engaged, events <= 1 AND NOT (views >= 2 OR purchases > 0) AS is_bounce FROM (
  SELECT user_id, sess_num, min(ts) AS session_start, max(ts) AS session_end, arg_min(event_type, (ts, event_id)) AS first_event_type,
         arg_max(event_type, (ts, event_id)) AS last_event_type, count(*) AS events, count(*) FILTER (WHERE event_type = 'view') AS views,
         count(*) FILTER (WHERE event_type = 'purchase') AS purchases
  FROM ({_numbered(gap)}) GROUP BY user_id, sess_num)"""


_S6 = _sessions(6 * 3600)
_ENGAGEMENT = f"""count(*) AS sessions, count(DISTINCT user_id) AS users, sum(events) AS events, sum(purchases) AS purchases,
  {_rate("count(*) FILTER (WHERE is_engaged)", "count(*)")} AS engagement_rate, {_rate("count(*) FILTER (WHERE is_bounce)", "count(*)")} AS bounce_rate,
  {_rate("sum(purchases)", "count(*)")} AS conversion_rate"""
_DAILY = f"SELECT CAST(o_orderdate AS DATE) AS order_date, count(*) AS orders, count(DISTINCT o_custkey) AS customers, CAST(sum({_P}) AS DECIMAL(18,2)) AS revenue FROM orders GROUP BY 1"
_ORDER_STATS = f"""
SELECT o_custkey AS c_custkey, count(*) AS orders, CAST(min(o_orderdate) AS DATE) AS first_order, CAST(max(o_orderdate) AS DATE) AS last_order,
       CAST(arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS DECIMAL(18,2)) AS first_value, CAST(arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS DECIMAL(18,2)) AS last_value,
       CAST(sum({_P}) AS DECIMAL(18,2)) AS total_spent FROM orders GROUP BY 1"""
_TOKEN = "'tok_' || substr(sha256('pepper-of-the-tests|name|' || lower(trim(c_name))), 1, 32)"
_PROFILES = """
SELECT 'customer' AS source, CAST(c_custkey AS VARCHAR) AS source_id, c_nationkey || '-' || (c_custkey % 100) AS email_token, c_custkey AS staged_at, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_nationkey || '-' || (s_suppkey % 100), s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) FROM supplier"""
_EXACT = f"""
SELECT unified_id, source, source_id, CASE WHEN row_number() OVER (PARTITION BY unified_id ORDER BY staged_at, source, source_id) = 1 THEN 'new_entity' ELSE 'exact_email' END AS match_type,
       CAST(1 AS DECIMAL(3,2)) AS match_confidence
FROM (SELECT *, 'U-' || substr(sha256(email_token), 1, 32) AS unified_id FROM ({_PROFILES}))"""
_FUNNEL = """
WITH f AS (SELECT CAST(ts AS DATE) AS event_date, user_id, max(event_type = 'view')::INT AS a, max(event_type = 'click')::INT AS b,
           max(event_type = 'signup')::INT AS c, max(event_type = 'purchase')::INT AS d FROM events
           WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY ALL),
s AS (SELECT event_date, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM f GROUP BY 1),
u AS (SELECT event_date, 1 AS step_number, 'view' AS step_name, a AS step_users, a - b AS dropoff FROM s
      UNION ALL SELECT event_date, 2, 'click', b, b - c FROM s UNION ALL SELECT event_date, 3, 'signup', c, c - d FROM s UNION ALL SELECT event_date, 4, 'purchase', d, 0 FROM s)
SELECT *, coalesce(round(CAST(dropoff AS DOUBLE) / nullif(CAST(step_users AS DOUBLE), 0), 4), 0) AS dropoff_rate FROM u"""
_DELTA = f"SELECT o_orderkey, 'X' AS o_orderstatus, {_P} AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0"
_BASE = f"SELECT o_orderkey, o_orderstatus, {_P} AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0"
_GOLD = ", ".join(
    f"arg_min({c}, (-coalesce(match_confidence, 0), -epoch_us(updated_at), coalesce({c}, ''))) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    for c in ("city", "country_code", "company", "job_title", "currency")
)

_PREFIX = "CASE WHEN left(a, 1) <> left(b, 1) THEN 0 WHEN left(a, 2) <> left(b, 2) THEN 1 WHEN left(a, 3) <> left(b, 3) THEN 2 WHEN left(a, 4) <> left(b, 4) THEN 3 ELSE 4 END"
_FUZZY = f"""
WITH p AS ({_PROFILES}), c AS (SELECT DISTINCT l.source_id AS l_id, r.source_id AS r_id, lower(l.name) AS a, lower(r.name) AS b, l.email_token AS x, r.email_token AS y FROM p l JOIN p r ON l.source = 'supplier' AND r.source = 'customer'
  AND (l.email_token = r.email_token OR (l.nation = r.nation AND right(l.name, 3) = right(r.name, 3)))),
t AS (SELECT *, round(0.7 * (jaro_similarity(a, b) + {_PREFIX} * 0.1 * (1 - jaro_similarity(a, b))) + 0.3 * (1 - levenshtein(x, y) / greatest(length(x), length(y))), 6) AS score FROM c)
SELECT l_id, arg_min(r_id, (-score, r_id)) AS r_id, max(score) AS score FROM t WHERE score >= 0.5 GROUP BY 1"""

_PHONE = "CASE WHEN length(regexp_replace(phone, '[^0-9+]', '', 'g')) >= 7 THEN regexp_replace(phone, '[^0-9+]', '', 'g') END"


def _low(c: str) -> str:
    return f"nullif(lower(trim({c}, ' ')), '')"


def _tok(kind: str, value: str) -> str:
    return f"'tok_' || substr(sha256('pepper-of-the-tests|{kind}|' || {value}), 1, 32)"


ORACLE = {
    "order_summary": f"SELECT CAST(o_orderdate AS DATE) AS order_date, n_name, o_orderpriority, count(*) AS total_orders, count(DISTINCT o_custkey) AS customers, CAST(sum({_P}) AS DECIMAL(18,2)) AS revenue, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished_orders, {_rate('count(*) FILTER (WHERE o_orderstatus = $$F$$)', 'count(*)')} AS finished_rate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3",
    "customer_metrics": f"SELECT c_custkey, c_mktsegment, coalesce(orders, 0) AS orders, first_order, last_order, first_value, last_value, total_spent, date_diff('day', last_order, DATE '2001-08-01') AS days_since_last, CASE WHEN orders > 1 THEN {_rate('date_diff($$day$$, first_order, last_order)', 'orders - 1', 2)} END AS order_frequency_days FROM customer LEFT JOIN ({_ORDER_STATS}) USING (c_custkey)",
    "payment_metrics": f"SELECT strftime(l_shipdate, '%Y-%m') AS month_key, l_linestatus, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, {_rate('count(*) FILTER (WHERE l_returnflag = $$R$$)', 'count(*)')} AS return_rate, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS largest FROM lineitem GROUP BY 1, 2",
    "campaign_metrics": f"SELECT *, {_rate('clicks', 'views')} AS click_rate, {_rate('purchases', 'clicks')} AS purchase_rate, {_rate('errors', '(views + clicks)')} AS error_rate FROM (SELECT CAST(ts AS DATE) AS event_date, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}s" for k in ("view", "click", "signup", "purchase", "error")) + " FROM events GROUP BY 1)",
    "events_dedup": "SELECT user_id, ts, event_type, max(event_id) AS event_id, arg_max(value, event_id) + 1 AS value, 2 AS loaded FROM events GROUP BY 1, 2, 3",
    "sessions": _sessions(1800),
    "sessions_6h": _S6,
    "engagement_daily": f"SELECT CAST(session_start AS DATE) AS session_date, {_ENGAGEMENT} FROM ({_S6}) GROUP BY 1",
    "engagement_by_channel": f"SELECT CAST(session_start AS DATE) AS session_date, first_event_type AS channel, {_ENGAGEMENT} FROM ({_S6}) GROUP BY 1, 2",
    "page_performance": f"SELECT CAST(ts AS DATE) AS event_date, event_type, count(*) AS events, count(*) FILTER (WHERE a = 1) AS entrances, count(*) FILTER (WHERE z = 1) AS exits, {_rate('count(*) FILTER (WHERE z = 1)', 'count(*)')} AS exit_rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sess_num ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, sess_num ORDER BY ts DESC, event_id DESC) AS z FROM ({_numbered(6 * 3600)})) GROUP BY 1, 2",
    "funnel": _FUNNEL,
    "sales_dashboard": f"""WITH d AS ({_DAILY}), t AS (SELECT order_date, n_name AS top_nation FROM (SELECT CAST(o_orderdate AS DATE) AS order_date, n_name, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY sum({_P}) DESC, n_name) AS rn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE rn = 1)
SELECT d.*, top_nation, dayofweek(order_date) + 1 AS day_of_week, dayname(order_date) AS day_name, weekofyear(order_date) AS week_of_year, quarter(order_date) AS quarter, year(order_date) AS year, strftime(order_date, '%Y-%m') AS month_key, dayofweek(order_date) IN (0, 6) AS is_weekend,
round(avg(orders) OVER (ORDER BY order_date ROWS 6 PRECEDING), 4) AS orders_mean_7, round(avg(orders) OVER (ORDER BY order_date ROWS 29 PRECEDING), 4) AS orders_mean_30 FROM d LEFT JOIN t USING (order_date)""",
    "sales_growth": f"SELECT order_date, revenue, previous_day, previous_week, {_rate('(revenue - previous_day)', 'previous_day')} AS growth_day, {_rate('(revenue - previous_week)', 'previous_week')} AS growth_week FROM (SELECT *, lag(revenue, 1) OVER (ORDER BY order_date) AS previous_day, lag(revenue, 7) OVER (ORDER BY order_date) AS previous_week FROM ({_DAILY}))",
    "executive_summary": " UNION ALL ".join(f"SELECT '{n}' AS period_type, count(*) AS orders, count(DISTINCT o_custkey) AS customers, CAST(sum({_P}) AS DECIMAL(18,2)) AS revenue, {_rate(f'sum({_P})', 'count(*)', 2)} AS order_value FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN date_trunc('{p}', DATE '2001-08-01') AND DATE '2001-08-01' HAVING count(*) > 0" for n, p in (("MTD", "month"), ("QTD", "quarter"), ("YTD", "year"))),
    "engagement_dashboard": f"""WITH s AS (SELECT CAST(session_start AS DATE) AS session_date, first_event_type FROM ({_S6})),
t AS (SELECT session_date, first_event_type AS top_channel FROM (SELECT session_date, first_event_type, row_number() OVER (PARTITION BY session_date ORDER BY count(*) DESC, first_event_type) AS rn FROM s GROUP BY 1, 2) WHERE rn = 1),
d AS (SELECT session_date, count(*) AS sessions, count(*) FILTER (WHERE first_event_type = 'view') AS from_view, count(*) FILTER (WHERE first_event_type = 'click') AS from_click, count(*) FILTER (WHERE first_event_type = 'purchase') AS from_purchase FROM s GROUP BY 1)
SELECT d.*, top_channel, round(avg(sessions) OVER (ORDER BY session_date ROWS 6 PRECEDING), 4) AS sessions_mean_7 FROM d LEFT JOIN t USING (session_date)""",
    "customer_360": f"SELECT c_custkey, c_name, orders, total_spent, returned_lines, events, last_seen, (orders IS NOT NULL)::INT + (returned_lines IS NOT NULL)::INT + (events IS NOT NULL)::INT AS source_count FROM customer LEFT JOIN (SELECT c_custkey, orders, total_spent FROM ({_ORDER_STATS})) USING (c_custkey) LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) USING (c_custkey) LEFT JOIN (SELECT user_id AS c_custkey, count(*) AS events, CAST(max(ts) AS DATE) AS last_seen FROM events GROUP BY 1) USING (c_custkey)",
    "tokenized_customers": f"SELECT c_custkey, {_TOKEN} AS c_name_token FROM customer",
    "vault": f"SELECT {_TOKEN} AS token, 'name' AS pii_class, min(lower(trim(c_name))) AS value, 1 AS key_version FROM customer GROUP BY 1",
    "entity_exact": _EXACT,
    "blocking_index": f"SELECT 'email:' || email_token AS blocking_key, 'email' AS blocking_key_type, source, source_id FROM ({_PROFILES}) UNION ALL SELECT 'name_zip:' || lower(substr(name, 1, 3)) || '_' || nation, 'name_zip', source, source_id FROM ({_PROFILES})",
    "entity_quality": f"SELECT * FROM (SELECT count(*) AS records, sum(n) AS rows, count(*) FILTER (WHERE n > 1) AS repeated_records, count(*) FILTER (WHERE ids > 1) AS split_records FROM (SELECT count(*) AS n, count(DISTINCT unified_id) AS ids FROM ({_EXACT}) GROUP BY source, source_id)), (SELECT count(*) AS entities, count(*) FILTER (WHERE s > 1) AS cross_source_entities FROM (SELECT count(DISTINCT source) AS s FROM ({_EXACT}) GROUP BY unified_id))",
    "entity_cardinality": f"SELECT least(n, 4) AS records, count(*) AS entities FROM (SELECT count(*) AS n FROM ({_EXACT}) GROUP BY unified_id) GROUP BY 1",
    "entity_blocked_pairs": f"WITH p AS ({_PROFILES}) SELECT DISTINCT l.source_id AS l_id, r.source_id AS r_id FROM p l JOIN p r ON l.source = 'supplier' AND r.source = 'customer' AND (l.email_token = r.email_token OR (l.nation = r.nation AND right(l.name, 3) = right(r.name, 3)))",
    "json_extract": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "asof_join": "SELECT event_id, user_id, ts, arg_max(purchase_id, (pts, CAST(purchase_id AS VARCHAR))) AS asof_purchase_id FROM events LEFT JOIN (SELECT user_id AS u, ts AS pts, event_id AS purchase_id FROM events WHERE event_type = 'purchase') ON u = user_id AND pts <= ts GROUP BY 1, 2, 3",
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)",
    "semi_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "merge_upsert": f"SELECT * FROM ({_BASE}) WHERE o_orderkey % 2 <> 0 UNION ALL {_DELTA}",
    "merge_insert": f"{_BASE} UNION ALL SELECT * FROM ({_DELTA}) WHERE o_orderkey % 3 = 0",
    "time_travel": f"WITH a AS (SELECT count(*) AS n FROM ({_BASE})), b AS (SELECT count(*) AS n FROM (SELECT o_orderkey FROM ({_BASE}) UNION SELECT o_orderkey FROM ({_DELTA}))) SELECT 1 AS version, n AS rows FROM a UNION ALL SELECT 2, n FROM b UNION ALL SELECT 3, a.n + b.n FROM a, b UNION ALL SELECT 4, n FROM a",
    "incremental_equals_full": f"SELECT strftime(o_orderdate, '%Y-%m') AS month_key, count(*) AS orders, CAST(sum({_P}) AS DECIMAL(18,2)) AS revenue FROM orders GROUP BY 1",
    "stream_raw_append": "SELECT event_id, ts, user_id, event_type, value FROM events",
    "stream_window_counts": "SELECT CAST(ts AS DATE) AS event_date, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "bench_simple": f"SELECT count(*) AS orders, CAST(sum({_P}) AS DECIMAL(18,2)) AS revenue FROM orders",
    "bench_filter": "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY 1",
    "bench_join": f"SELECT n_name, count(*) AS orders, CAST(sum({_P}) AS DECIMAL(18,2)) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY revenue DESC, n_name LIMIT 10",
    "bench_analytics": f"SELECT order_date, revenue, CAST(sum(revenue) OVER (ORDER BY order_date) AS DECIMAL(18,2)) AS running_revenue FROM ({_DAILY})",
    "null_rate": "SELECT " + ", ".join(f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS {c}" for c in ("email_token", "city", "country_code", "match_confidence")) + " FROM core_customers",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("orders", "lineitem", "events", "core_orders", "entity_index")),
    "top_users": "SELECT user_id, count(*) AS events FROM events GROUP BY 1 ORDER BY events DESC, user_id LIMIT 20",
    "replacing_merge": "SELECT source_table, pipeline_name, max(epoch_us(updated_at)) AS updated_us, arg_max(coalesce(records_processed, -1), (epoch_us(updated_at), coalesce(records_processed, -1))) AS records_processed FROM incremental_watermarks GROUP BY 1, 2",
    "summing_merge": "SELECT source_table, status, sum(records_processed) AS records, sum(bytes_processed) AS bytes FROM incremental_watermarks GROUP BY 1, 2",
    "median_value": "SELECT event_type, round(median(value), 4) AS median_value FROM events GROUP BY 1",
    "staged_customers": f"SELECT CAST(id AS VARCHAR) AS customer_id, {_tok('email', _low('email'))} AS email_token, {_tok('phone', _PHONE)} AS phone_token, coalesce(CASE WHEN json_valid(addresses) AND json_type(addresses) = 'ARRAY' THEN json_array_length(addresses) END, 0) AS address_count, total_spent, epoch_us(updated_at) AS updated_us, _webhook_topic FROM shopify_customers",
    "staged_subscribers": f"""SELECT {_tok('mailchimp_id', _low('subscriber_id'))} AS subscriber_id_token, CASE WHEN {_low('email_address')} IS NOT NULL THEN {_tok('email', _low('email_address'))} END AS email_token, coalesce(sms_status = 'subscribed', false) AS has_sms,
epoch_us(_loaded_at) AS loaded_us, epoch_us(last_changed) AS changed_us, epoch_us(timestamp_signup) AS signup_us FROM (SELECT *, row_number() OVER (PARTITION BY {_low('subscriber_id')} ORDER BY _loaded_at DESC NULLS LAST, last_changed DESC NULLS LAST) AS rn FROM mailchimp_subscribers) WHERE rn = 1""",
    "golden_customers": f"SELECT customer_id, {_GOLD} FROM core_customers WHERE customer_id IS NOT NULL GROUP BY 1",
    "entity_fuzzy": _FUZZY,
    "coverage": f"SELECT coalesce(source, 'unknown') AS source, count(*) AS rows, {_rate('sum((match_type <> $$new_entity$$)::BIGINT)', 'count(*)')} AS matched_rate FROM entity_index GROUP BY 1",
}
