"""Serving roll-ups and panels, quality report, gauges and alerts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import metrics
from tributary.functions.exprs import money, rate
from tributary.operators import pii, quality, staging
from tributary.operators.windows import latest_per_key
from tributary.plans import staged, tables
from tributary.plans.tables import PEPPER
from tributary.session import saved, scratch, table
from tributary.sources import scans
from tributary.sources.lake import LakeTable

#: The day that relative windows of the events end at.
EVENTS_AS_OF = datetime.date(2024, 1, 20)
RANGE = ("2024-03-01", "2024-09-30")


# -- roll-ups that are served ---------------------------------------------------------------------------------------


def revenue_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("hour", "o_orderdate").alias("hour")).agg(F.count(F.lit(1)).alias("orders"), money(F.sum(money("o_totalprice"))).alias("revenue"), F.count_distinct("o_custkey").alias("customers"))


def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by market segment with their orders' means."""
    m = tables.customer_metrics(spark, sf_dir)
    return m.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), money(F.sum("total_spent")).alias("revenue"), F.round(F.avg("orders"), 6).alias("mean_orders"), F.round(F.avg("days_since_last"), 6).alias("mean_recency"))


def card_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = staged._staged_charges(spark, sf_dir)
    n, paid = F.count(F.lit(1)), F.sum((F.col("amount_captured") > 0).cast("bigint"))
    return c.groupBy("card_brand").agg(n.alias("charges"), paid.alias("captured"), F.sum("amount").cast("decimal(18,2)").alias("volume"), rate(paid, n).alias("captured_rate"))


def _recent(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    s = tables.sessions_6h(spark, sf_dir).withColumn("session_date", F.to_date("session_start"))
    return s.where(F.col("session_date") >= F.date_sub(F.lit(EVENTS_AS_OF), days))


def engagement_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the last seven days by day."""
    n, engaged = F.count(F.lit(1)), F.sum(F.col("is_engaged").cast("bigint"))
    seconds = F.unix_seconds(F.col("session_end").cast("timestamp")) - F.unix_seconds(F.col("session_start").cast("timestamp"))
    return _recent(spark, sf_dir, 7).groupBy("session_date").agg(n.alias("sessions"), engaged.alias("engaged"), rate(engaged, n).alias("engagement_rate"), F.round(F.avg(seconds), 4).alias("mean_seconds"), F.count_distinct("user_id").alias("users"))


def _by(spark: SparkSession, sf_dir: str, column: str, name: str) -> DataFrame:
    n, engaged = F.count(F.lit(1)), F.sum(F.col("is_engaged").cast("bigint"))
    return _recent(spark, sf_dir, 30).groupBy(F.col(column).alias(name)).agg(n.alias("sessions"), engaged.alias("engaged"), rate(engaged, n).alias("engagement_rate"), F.count_distinct("user_id").alias("users"))


def traffic_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(spark, sf_dir, "first_event_type", "traffic_source")


def exit_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(spark, sf_dir, "last_event_type", "exit_type")


# -- panels -----------------------------------------------------------------------------------------------------------


def panel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single numbers of the dashboards, one row each."""
    m, e, c = tables.customer_metrics(spark, sf_dir), tables.engagement_daily(spark, sf_dir), tables.campaign_metrics(spark, sf_dir)
    one = lambda df, **values: df.agg(*[v.cast("double").alias(n) for n, v in values.items()])
    parts = [
        one(m, customers=F.count(F.lit(1)), spent=F.sum("total_spent"), mean_spent=F.round(F.avg("total_spent"), 4)),
        one(tables.order_summary(spark, sf_dir), summary_rows=F.count(F.lit(1))),
        one(c, campaign_days=F.count(F.lit(1)), mean_click_rate=F.round(F.avg("click_rate"), 6), mean_purchase_rate=F.round(F.avg("purchase_rate"), 6)),
        one(e, sessions=F.sum("sessions"), daily_users=F.sum("users"), mean_engagement=F.round(F.avg("engagement_rate"), 6), mean_bounce=F.round(F.avg("bounce_rate"), 6)),
    ]
    rows = [p.unpivot([], p.columns, "panel", "value") for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def daily_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day of orders, with what payments, e-mail events, sessions and generated visits say of that day; every
    side is one row a day before its join."""
    orders = tables._daily_sales(spark, sf_dir).select(F.col("order_date").alias("day"), "orders", "revenue")
    paid = staged.payments_daily(spark, sf_dir).select(F.col("payment_date").alias("day"), "charges", "captured")
    mail = staged._staged_email_events(spark, sf_dir).groupBy(F.col("event_date").alias("day")).agg(F.count(F.lit(1)).alias("mails"))
    seen = tables.engagement_daily(spark, sf_dir).select(F.col("session_date").alias("day"), "sessions")
    raw = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("errors"))
    out = orders
    for side in (paid, mail, seen, raw):
        out = out.join(side, "day", "left")
    return out.fillna(0, ["charges", "captured", "mails", "sessions", "errors"])


def subscribers_over_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each subscriber over two staged batches, the second of which holds late and newer loads."""
    s = table(spark, sf_dir, "mailchimp_subscribers")
    batches = [staging.stage(s.where(c), staging.SPECS["mailchimp_subscribers"], PEPPER)[0].withColumn("batch", F.lit(i)) for i, c in enumerate(("_webhook_event_type <> 'profile' or _webhook_event_type is null", "_webhook_event_type = 'profile'"))]
    both = batches[0].unionByName(batches[1]).select("subscriber_id_token", "has_sms", F.unix_micros("_loaded_at").alias("loaded_us"), F.unix_micros("last_changed").alias("changed_us"))
    return latest_per_key(both, ["subscriber_id_token"], ["loaded_us", "changed_us"])


def panel_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.customer_metrics(spark, sf_dir).select("c_custkey", "orders", "total_spent").orderBy(F.desc_nulls_last("total_spent"), "c_custkey").limit(100)


def panel_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sales_dashboard(spark, sf_dir).select("order_date", "day_name", "revenue", "orders", "customers").orderBy(F.desc("order_date")).limit(30)


def panel_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.page_performance(spark, sf_dir)
    return p.groupBy("event_type").agg(F.sum("events").alias("events"), F.sum("entrances").alias("entrances"), F.round(F.avg("exit_rate"), 6).alias("mean_exit_rate")).orderBy(F.desc("events"), "event_type").limit(20)


def panel_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.funnel(spark, sf_dir)
    return f.groupBy("step_number", "step_name").agg(F.sum("step_users").alias("step_users"), F.round(F.avg("dropoff_rate"), 6).alias("mean_dropoff"))


def orders_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are no tests, of the days of a range, both ends included."""
    o = table(spark, sf_dir, "core_orders").where(~F.coalesce("is_test", F.lit(False)))
    day = F.to_date(F.to_utc_timestamp("order_date", F.current_timezone()))
    return o.where(day.between(*[F.lit(x).cast("date") for x in RANGE])).groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"), F.sum("total_price").cast("decimal(18,2)").alias("total"))


def empty_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the vault without its rows."""
    return tables.vault(spark, sf_dir).limit(0)


# -- retention, views, files ------------------------------------------------------------------------------------------


def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last seven days before the day the windows end at: what a store with a time to live keeps."""
    keep = F.to_timestamp_ntz(F.lit(str(EVENTS_AS_OF - datetime.timedelta(days=7))))
    return table(spark, sf_dir, "events").where(F.col("ts") >= keep).select("event_id", "ts", "user_id")


def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table registered as a view and counted by SQL."""
    names = scans.register_views(spark, sf_dir, "served_")
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM served_{n}" for n in names if n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")))


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as JSON lines and as Parquet and read again."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = []
    for kind in ("json", "parquet"):
        path = scans.write_files(n, scratch(spark, "files"), kind)
        parts.append(spark.read.schema(n.schema).format(kind).load(path).withColumn("format", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def generated_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of two generated sources that are drawn from one pool: how many occur in both."""
    shop = scans.generate_people(spark, "shop", 4000, pool=1500).select("person").distinct()
    mail = scans.generate_people(spark, "mail", 3000, pool=1500).select("person").distinct()
    return shop.join(mail, "person").agg(F.count(F.lit(1)).alias("in_both"))


# -- quality, gauges, alerts --------------------------------------------------------------------------------------------


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the entity index and the status that follows."""
    sources = {n: table(spark, sf_dir, n).select(F.col(c).cast("string").alias("source_id")) for n, c in (("shopify_customers", "id"), ("mailchimp_subscribers", "subscriber_id"))}
    return quality.report(table(spark, sf_dir, "entity_index"), sources)


def natural_key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "core_orders"), ["order_id"]).select("order_id", "rows")


def vault_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in the vault of the staged contacts by class."""
    _, vault = staging.stage(staged.raw_hubspot_contacts(spark, sf_dir), staging.SPECS["hubspot_contacts"], PEPPER)
    return vault.groupBy("pii_class").agg(F.count(F.lit(1)).alias("entries"))


def table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges of a table of the store after two writes, from its log and its files' footers."""
    t = LakeTable(spark, scratch(spark, "gauges"))
    nation = table(spark, sf_dir, "nation").coalesce(1)
    t.replace(nation)
    t.append(nation)
    return metrics.frame(spark, metrics.table_gauges("core", "nation", t))


def entity_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each source and records under several entities."""
    i = table(spark, sf_dir, "entity_index")
    covered = tables.coverage(spark, sf_dir).select(F.lit("entity_coverage_percent").alias("name"), F.col("source").alias("label"), F.round(F.col("matched_rate") * 100, 4).alias("value"))
    split = i.groupBy("source", "source_id").agg(F.count_distinct("unified_id").alias("n")).agg(F.sum((F.col("n") > 1).cast("bigint")).cast("double").alias("value"))
    return covered.unionByName(split.select(F.lit("entity_duplicate_records").alias("name"), F.lit("all").alias("label"), "value"))


def pii_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of nulls of token columns, and vault entries by class."""
    columns = ["email_token", "phone_token", "first_name_token"]
    nulls = pii.null_rates(table(spark, sf_dir, "core_customers").select(*columns)).unpivot([], columns, "label", "value").select(F.lit("column_null_rate").alias("name"), F.regexp_replace("label", "_token$", "").alias("label"), "value")
    return nulls.unionByName(vault_classes(spark, sf_dir).select(F.lit("vault_entries").alias("name"), F.col("pii_class").alias("label"), F.col("entries").cast("double").alias("value")))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts that a day's samples raise: sums of kinds of events stand for the gauges of jobs and tables."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("label"), "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    names = {"view": "table_files", "click": "table_snapshots", "signup": "job_last_failure", "purchase": "job_last_success", "error": "job_duration_seconds"}
    samples = e.select(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")].alias("name"), F.create_map(F.lit("table"), F.col("label")).alias("labels"), F.col("n").alias("value"))
    rules = [
        metrics.Rule("too many files", "table_files", ">", 100), metrics.Rule("too many snapshots", "table_snapshots", ">", 50),
        metrics.Rule("slow job", "job_duration_seconds", ">", 60), metrics.Rule("failed since", "job_last_failure", ">", 0, minus="job_last_success"), metrics.Rule("few views a file", "table_snapshots", "<", 0.5, over="table_files"),
    ]
    return metrics.firing(samples, rules).select("alert", F.col("labels")["table"].alias("label"), F.round("value", 6).alias("value"))


def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag of each group on each topic: many groups' committed offsets against one latest offset a partition."""
    s = table(spark, sf_dir, "shopify_customers_source").select(F.lit("shopify.customers").alias("topic"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"))
    latest = s.groupBy("topic", "partition").agg(F.max("offset").alias("latest"))
    committed = s.groupBy("topic", "partition").agg(F.max(F.when(F.col("offset") % 2 == 0, F.col("offset"))).alias("stage"), F.min("offset").alias("archive")).unpivot(["topic", "partition"], ["stage", "archive"], "consumer_group", "committed")
    return committed.join(latest, ["topic", "partition"]).groupBy("consumer_group", "topic").agg(F.sum(F.col("latest") - F.coalesce("committed", F.lit(0))).alias("lag"))


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row a resolution batch leaves in its statistics table: records taken, new, matched, mean confidence."""
    batch = saved(tables.entity_exact(spark, sf_dir), "stats-batch")
    t = LakeTable(spark, scratch(spark, "stats"))
    t.append(quality.batch_stats(batch, "exact", "2024-06-01 00:00:00"))
    return t.read().select("method", "records", "new_entities", "matched", "mean_confidence")


NAMES = [
    "revenue_hourly", "segment_summary", "card_performance", "engagement_trend", "traffic_performance", "exit_performance", "panel_totals", "daily_overview", "subscribers_over_batches", "panel_top_customers", "panel_sales", "panel_pages", "panel_funnel",
    "orders_in_range", "empty_like", "retained_events", "view_counts", "file_formats", "generated_overlap", "quality_report", "natural_key_duplicates", "vault_classes", "table_metrics", "entity_gauges", "pii_gauges", "alerts",
    "consumer_lag", "batch_stats",
]
QUERIES = {n: globals()[n] for n in NAMES}
