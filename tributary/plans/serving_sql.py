"""SQL of the queries in serving.py, for DuckDB."""

from tributary.plans.staged_sql import _CHARGES, _CONTACTS
from tributary.plans.tables_sql import ORACLE as T
from tributary.plans.tables_sql import _DAILY, _P, _S6, _rate

_AS_OF = "DATE '2024-01-20'"
_RECENT = f"SELECT *, CAST(session_start AS DATE) AS session_date FROM ({_S6})"
_BY = f"""count(*) AS sessions, count(*) FILTER (WHERE is_engaged) AS engaged, {_rate("count(*) FILTER (WHERE is_engaged)", "count(*)")} AS engagement_rate, count(DISTINCT user_id) AS users"""
_CAPTURED = "count(*) FILTER (WHERE amount_captured > 0)"


def _panels(source: str, **values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS panel, CAST({v} AS DOUBLE) AS value FROM ({source})" for n, v in values.items())


def _covered(name: str, c: str) -> str:
    return f"SELECT 'coverage_percent:{name}' AS metric, coalesce(round(100.0 * count(r.source_id) / nullif(count(*), 0), 4), 0) AS value FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS id FROM {name} WHERE {c} IS NOT NULL) LEFT JOIN (SELECT DISTINCT source_id FROM entity_index WHERE source = '{name}' AND source_id IS NOT NULL) r ON r.source_id = id"


_REPORT = f"""
WITH r AS (SELECT source, source_id, count(DISTINCT unified_id) AS ids FROM entity_index WHERE source IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2),
e AS (SELECT unified_id, count(DISTINCT source) AS sources FROM entity_index WHERE unified_id IS NOT NULL GROUP BY 1),
m AS (SELECT 'records' AS metric, CAST(count(*) AS DOUBLE) AS value FROM r UNION ALL SELECT 'split_records', count(*) FILTER (WHERE ids > 1) FROM r UNION ALL SELECT 'entities', count(*) FROM e
  UNION ALL SELECT 'cross_source_percent', round(100.0 * count(*) FILTER (WHERE sources > 1) / count(*), 4) FROM e UNION ALL {_covered('shopify_customers', 'id')} UNION ALL {_covered('mailchimp_subscribers', 'subscriber_id')}),
j AS (SELECT *, CASE WHEN metric = 'cross_source_percent' THEN 5.0 WHEN metric LIKE 'coverage_percent%' THEN 95.0 WHEN metric = 'split_records' THEN 0.0 END AS threshold FROM m),
s AS (SELECT *, CASE WHEN metric = 'split_records' AND value > 0 THEN 'error' WHEN metric <> 'split_records' AND value < threshold THEN 'warning' ELSE 'info' END AS status FROM j),
w AS (SELECT max(CASE status WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS code FROM s)
SELECT * FROM s UNION ALL SELECT 'overall', code, NULL, CASE code WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END FROM w"""
_VAULT = "SELECT pii_class, count(DISTINCT token) AS entries FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS pii_class, {c} AS token FROM ({_CONTACTS})" for c, k in (("email_token", "email"), ("first_name_token", "name"), ("last_name_token", "name"), ("full_name_token", "name"), ("mobile_phone_token", "phone"))) + " UNION ALL SELECT 'name_prefix', lower(substr(c_name, 1, 3)) FROM customer WHERE c_custkey % 35 <> 0) WHERE token IS NOT NULL GROUP BY 1"
_KINDS = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS label, " + ", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{k}'), 0) AS {k}" for k in ("view", "click", "signup", "purchase", "error")) + " FROM events GROUP BY 1"
_OFFSETS = "SELECT kafka_partition AS p, max(kafka_offset) AS latest, max(kafka_offset) FILTER (WHERE kafka_offset % 2 = 0) AS stage, min(kafka_offset) AS archive FROM shopify_customers_source GROUP BY 1"

ORACLE = {
    "revenue_hourly": f"SELECT date_trunc('hour', o_orderdate) AS hour, count(*) AS orders, CAST(sum({_P}) AS DECIMAL(18,2)) AS revenue, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
    "segment_summary": f"SELECT c_mktsegment, count(*) AS customers, CAST(sum(total_spent) AS DECIMAL(18,2)) AS revenue, round(avg(orders), 6) AS mean_orders, round(avg(days_since_last), 6) AS mean_recency FROM ({T['customer_metrics']}) GROUP BY 1",
    "card_performance": f"SELECT card_brand, count(*) AS charges, {_CAPTURED} AS captured, CAST(sum(amount) AS DECIMAL(18,2)) AS volume, {_rate(_CAPTURED, 'count(*)')} AS captured_rate FROM ({_CHARGES}) GROUP BY 1",
    "engagement_trend": f"SELECT session_date, count(*) AS sessions, count(*) FILTER (WHERE is_engaged) AS engaged, {_rate('count(*) FILTER (WHERE is_engaged)', 'count(*)')} AS engagement_rate, round(avg(date_diff('second', date_trunc('second', session_start), date_trunc('second', session_end))), 4) AS mean_seconds, count(DISTINCT user_id) AS users FROM ({_RECENT}) WHERE session_date >= {_AS_OF} - 7 GROUP BY 1",
    "traffic_performance": f"SELECT first_event_type AS traffic_source, {_BY} FROM ({_RECENT}) WHERE session_date >= {_AS_OF} - 30 GROUP BY 1",
    "exit_performance": f"SELECT last_event_type AS exit_type, {_BY} FROM ({_RECENT}) WHERE session_date >= {_AS_OF} - 30 GROUP BY 1",
    "panel_totals": " UNION ALL ".join([
        _panels(T["customer_metrics"], customers="count(*)", spent="sum(total_spent)", mean_spent="round(avg(total_spent), 4)"),
        _panels(T["order_summary"], summary_rows="count(*)"),
        _panels(T["campaign_metrics"], campaign_days="count(*)", mean_click_rate="round(avg(click_rate), 6)", mean_purchase_rate="round(avg(purchase_rate), 6)"),
        _panels(T["engagement_daily"], sessions="sum(sessions)", daily_users="sum(users)", mean_engagement="round(avg(engagement_rate), 6)", mean_bounce="round(avg(bounce_rate), 6)"),
    ]),
    "daily_overview": f"""WITH o AS ({_DAILY}), p AS (SELECT CAST(make_timestamp(created_us) AS DATE) AS day, count(*) AS charges, {_CAPTURED} AS captured FROM ({_CHARGES}) GROUP BY 1), m AS (SELECT CAST(ts AS DATE) AS day, count(*) AS mails, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1),
s AS (SELECT CAST(session_start AS DATE) AS day, count(*) AS sessions FROM ({_S6}) GROUP BY 1)
SELECT order_date AS day, orders, revenue, coalesce(charges, 0) AS charges, coalesce(captured, 0) AS captured, coalesce(mails, 0) AS mails, coalesce(sessions, 0) AS sessions, coalesce(errors, 0) AS errors FROM o LEFT JOIN p ON p.day = order_date LEFT JOIN m ON m.day = order_date LEFT JOIN s ON s.day = order_date""",
    "subscribers_over_batches": f"SELECT subscriber_id_token, has_sms, loaded_us, changed_us FROM ({T['staged_subscribers']})",
    "panel_top_customers": f"SELECT c_custkey, orders, total_spent FROM ({T['customer_metrics']}) ORDER BY total_spent DESC NULLS LAST, c_custkey LIMIT 100",
    "panel_sales": f"SELECT order_date, day_name, revenue, orders, customers FROM ({T['sales_dashboard']}) ORDER BY order_date DESC LIMIT 30",
    "panel_pages": f"SELECT event_type, sum(events) AS events, sum(entrances) AS entrances, round(avg(exit_rate), 6) AS mean_exit_rate FROM ({T['page_performance']}) GROUP BY 1 ORDER BY events DESC, event_type LIMIT 20",
    "panel_funnel": f"SELECT step_number, step_name, sum(step_users) AS step_users, round(avg(dropoff_rate), 6) AS mean_dropoff FROM ({T['funnel']}) GROUP BY 1, 2",
    "orders_in_range": "SELECT order_status, count(*) AS orders, CAST(sum(total_price) AS DECIMAL(18,2)) AS total FROM core_orders WHERE NOT coalesce(is_test, false) AND CAST(order_date AT TIME ZONE 'UTC' AS DATE) BETWEEN DATE '2024-03-01' AND DATE '2024-09-30' GROUP BY 1",
    "empty_like": f"SELECT * FROM ({T['vault']}) WHERE false",
    "retained_events": f"SELECT event_id, ts, user_id FROM events WHERE ts >= {_AS_OF} - 7",
    "view_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")),
    "file_formats": "SELECT n_nationkey, n_name, format FROM nation, (VALUES ('json'), ('parquet')) f(format)",
    "generated_overlap": "SELECT count(*) AS in_both FROM (SELECT CAST('0x' || substr(md5('42|shop|person|' || range), 1, 12) AS BIGINT) % 1500 FROM range(4000) INTERSECT SELECT CAST('0x' || substr(md5('42|mail|person|' || range), 1, 12) AS BIGINT) % 1500 FROM range(3000))",
    "quality_report": _REPORT,
    "natural_key_duplicates": "SELECT order_id, count(*) AS rows FROM core_orders WHERE order_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "vault_classes": _VAULT,
    "table_metrics": "SELECT 'table_rows' AS name, 'layer=core,table=nation' AS labels, CAST(2 * (SELECT count(*) FROM nation) AS DOUBLE) AS value UNION ALL SELECT 'table_files', 'layer=core,table=nation', 2.0 UNION ALL SELECT 'table_snapshots', 'layer=core,table=nation', 2.0",
    "entity_gauges": f"SELECT 'entity_coverage_percent' AS name, source AS label, round(matched_rate * 100, 4) AS value FROM ({T['coverage']}) UNION ALL SELECT 'entity_duplicate_records', 'all', count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT unified_id) AS n FROM entity_index GROUP BY source, source_id)",
    "pii_gauges": " UNION ALL ".join(f"SELECT 'column_null_rate' AS name, '{c}' AS label, round(count(*) FILTER (WHERE {c}_token IS NULL) / count(*), 6) AS value FROM core_customers" for c in ("email", "phone", "first_name")) + f" UNION ALL SELECT 'vault_entries', pii_class, entries FROM ({_VAULT})",
    "alerts": f"""WITH k AS ({_KINDS}) SELECT 'too many files' AS alert, label, CAST(view AS DOUBLE) AS value FROM k WHERE view > 100 UNION ALL SELECT 'too many snapshots', label, click FROM k WHERE click > 50 UNION ALL SELECT 'slow job', label, error FROM k WHERE error > 60
UNION ALL SELECT 'failed since', label, signup - purchase FROM k WHERE signup - purchase > 0 UNION ALL SELECT 'few views a file', label, round(click / view, 6) FROM k WHERE click / view < 0.5""",
    "consumer_lag": f"""WITH o AS ({_OFFSETS}) SELECT 'stage' AS consumer_group, 'shopify.customers' AS topic, sum(latest - coalesce(stage, 0)) AS lag FROM o UNION ALL SELECT 'archive', 'shopify.customers', sum(latest - archive) FROM o""",
    "batch_stats": f"SELECT 'exact' AS method, count(*) AS records, count(*) FILTER (WHERE match_type = 'new_entity') AS new_entities, count(*) FILTER (WHERE match_type <> 'new_entity') AS matched, 1.0 AS mean_confidence FROM ({T['entity_exact']})",
}
