"""SQL of the general data problems, for DuckDB."""

_NONE = "('', '-', 'n/a', 'null', 'none', 'unknown', 'undefined', '0')"

P5 = f"""
WITH o AS (
  SELECT order_id, order_date,
         CASE WHEN lower(trim(customer_id)) NOT IN {_NONE} THEN lower(trim(customer_id)) END AS c,
         CASE WHEN lower(trim(source_customer_id)) NOT IN {_NONE}
              THEN regexp_extract(trim(source_customer_id), '0*([0-9]+?)(\\.0)?$', 1) END AS s,
         min(staged_at) OVER (PARTITION BY order_id) AS staged
  FROM core_orders),
sh AS (
  SELECT CAST(id AS VARCHAR) AS s, arg_max(_webhook_topic, (updated_at, _webhook_received_at, _loaded_at)) AS topic,
         min(_loaded_at) AS arrived
  FROM shopify_customers GROUP BY id)
SELECT DISTINCT order_id, 'customer_id' AS field,
       CASE WHEN c IN (SELECT lower(trim(unified_id)) FROM entity_index) THEN 'deleted' ELSE 'missing' END AS kind,
       strftime(order_date AT TIME ZONE 'UTC', '%Y-%m') AS period
FROM o WHERE c IS NOT NULL AND c NOT IN (SELECT lower(trim(customer_id)) FROM core_customers WHERE customer_id IS NOT NULL)
UNION ALL
SELECT DISTINCT order_id, 'source_customer_id',
       CASE WHEN topic IS NULL THEN 'missing' WHEN topic = 'customers/delete' THEN 'deleted' ELSE 'late' END,
       strftime(order_date AT TIME ZONE 'UTC', '%Y-%m')
FROM o LEFT JOIN sh USING (s)
WHERE o.s IS NOT NULL AND (topic IS NULL OR topic = 'customers/delete' OR arrived > staged)
"""

_MESSAGES = """
SELECT 'shopify_customers' AS table_name, CAST(id AS VARCHAR) AS record_id, _webhook_topic AS event_kind,
       epoch_us(updated_at) AS version_us FROM shopify_customers
UNION ALL SELECT 'mailchimp_subscribers', lower(subscriber_id), _webhook_event_type, epoch_us(last_changed) FROM mailchimp_subscribers
UNION ALL SELECT 'incremental_watermarks', last_event_id, pipeline_name, epoch_us(last_sync_timestamp) FROM incremental_watermarks
"""

ORACLE = {
    "p5_found": P5,
    "p5_report": f"SELECT field, kind, period, count(*) AS orphans FROM ({P5}) GROUP BY ALL",
    "p7_found": f"SELECT * FROM ({_MESSAGES}) WHERE record_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "p7_messages": f"SELECT *, count(*) AS copies FROM ({_MESSAGES}) WHERE record_id IS NOT NULL GROUP BY ALL",
}
