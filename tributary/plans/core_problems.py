"""Queries of the general data problems (p1, p5, p6, p7)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.values import key_text, numeric_id
from tributary.operators.flatten import flatten_customers, flatten_subscribers
from tributary.operators.messages import COPIES, MessageStore
from tributary.operators.orphans import orphan_report, reference_states
from tributary.operators.skew import lookup_join
from tributary.operators.timestamps import candidates, normalise
from tributary.session import saved, scratch, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parent-child links of all nested columns."""
    customers = flatten_customers(table(spark, sf_dir, "shopify_customers"))
    subscribers = flatten_subscribers(table(spark, sf_dir, "mailchimp_subscribers"))
    return customers.unionByName(subscribers).select("parent_kind", "parent_id", "child_kind", "child_id").distinct()


def order_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (order_id, field, ref) of core_orders with the order's first staging and its period."""
    orders = table(spark, sf_dir, "core_orders").select(
        "order_id",
        key_text(F.col("customer_id")).alias("customer_id"),
        numeric_id(F.col("source_customer_id")).alias("source_customer_id"),
        "order_date",
        "staged_at",
    )
    orders = orders.groupBy("order_id", "customer_id", "source_customer_id").agg(F.min("order_date").alias("order_date"), F.min("staged_at").alias("staged"))
    staged = F.min("staged").over(Window.partitionBy("order_id"))
    fields = [F.struct(F.lit(f).alias("field"), F.col(f).alias("ref")) for f in ("customer_id", "source_customer_id")]
    orders = orders.withColumn("staged", staged).select("order_id", "order_date", "staged", F.explode(F.array(*fields)).alias("x"))
    return orders.select("order_id", "x.field", "x.ref", F.date_format(F.to_utc_timestamp("order_date", F.current_timezone()), "yyyy-MM").alias("period"), "staged").where("ref is not null")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer_id or source_customer_id is an orphan, with the kind and the month.

    Kinds as TESTDATA.md has them. Of messages with one latest updated_at, the one received last decides."""
    orders = saved(order_references(spark, sf_dir), "p5-refs")

    core = table(spark, sf_dir, "core_customers").select(key_text(F.col("customer_id")).alias("ref")).where("ref is not null").distinct()
    index = table(spark, sf_dir, "entity_index").select(key_text(F.col("unified_id")).alias("ref")).where("ref is not null").distinct()
    lost = reference_states(orders.where("field = 'customer_id'").select("ref"), core).where("not present").select("ref")
    lost = reference_states(lost, index).select("ref", F.when(F.col("present"), "deleted").otherwise("missing").alias("kind"))

    received = F.struct("updated_at", "_webhook_received_at", "_loaded_at")
    messages = table(spark, sf_dir, "shopify_customers").where("id is not null")
    parents = messages.groupBy(F.col("id").cast("string").alias("ref")).agg(F.max_by("_webhook_topic", received).alias("topic"), F.min("_loaded_at").alias("arrived"))
    state = reference_states(orders.where("field = 'source_customer_id'").select("ref"), parents)
    state = state.select("ref", F.when(~F.col("present"), "missing").when(F.col("topic") == "customers/delete", "deleted").alias("kind"), "arrived")

    customer = lookup_join(orders.where("field = 'customer_id'"), lost, "ref", "inner")
    source = lookup_join(orders.where("field = 'source_customer_id'"), state, "ref", "inner")
    source = source.withColumn("kind", F.coalesce("kind", F.when(F.col("arrived") > F.col("staged"), "late"))).where("kind is not null")
    columns = ["order_id", "field", "kind", "period"]
    return customer.select(columns).unionByName(source.select(columns)).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of orphans by field, kind and month."""
    return orphan_report(p5_found(spark, sf_dir), "field", "kind", "period")


#: Of each message table: SQL of the message's id, and the columns of its kind, its version and its delivery.
MESSAGES = {
    "shopify_customers": ("cast(id as string)", "_webhook_topic", "updated_at", "_loaded_at"),
    "mailchimp_subscribers": ("lower(subscriber_id)", "_webhook_event_type", "last_changed", "_loaded_at"),
    "incremental_watermarks": ("last_event_id", "pipeline_name", "last_sync_timestamp", "updated_at"),
}
MESSAGE_KEYS = ["record_id", "event_kind", "version_us"]


def delivered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The messages of a table with all their columns, and MESSAGE_KEYS."""
    record, kind, version, _ = MESSAGES[name]
    keys = [F.expr(record).alias("record_id"), F.col(kind).alias("event_kind"), F.unix_micros(F.col(version).cast("timestamp")).alias("version_us")]
    return table(spark, sf_dir, name).select(*keys, "*").where("record_id is not null")


def message_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole row a message of a table, with COPIES: of copies that differ, the one delivered last.

    They come out of a store of delivered() filled in two batches: what arrived before the last month that has
    arrivals, and that month's messages, whose copies in older partitions the identifier index finds."""
    arrived = MESSAGES[name][3]
    store = MessageStore(spark, scratch(spark, "p7-store"), MESSAGE_KEYS, [arrived], f"date_format({arrived}, 'yyyy-MM')")
    messages = delivered(spark, sf_dir, name)
    last = messages.agg(F.date_trunc("month", F.max(arrived)).alias("m")).first()["m"]
    if last is None:
        store.ingest(messages)
    else:
        store.ingest(messages.where((F.col(arrived) < F.lit(last)) | F.col(arrived).isNull()))
        store.ingest(messages.where(F.col(arrived) >= F.lit(last)))
    rows = store.read()
    return messages.withColumn(COPIES, F.lit(0).cast("bigint")) if rows is None else rows


def message_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all tables' messages with COPIES, from their stores. The small one is filled beside the two large
    ones, which follow each other, so that their shuffles do not fill the disks together."""
    lanes = (("shopify_customers", "mailchimp_subscribers"), ("incremental_watermarks",))
    with ThreadPoolExecutor(len(lanes)) as pool:
        stores = dict(x for lane in pool.map(lambda names: [(n, message_rows(spark, sf_dir, n)) for n in names], lanes) for x in lane)
    parts = [stores[n].select(F.lit(n).alias("table_name"), *MESSAGE_KEYS, COPIES) for n in MESSAGES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages that were delivered more than once."""
    return message_copies(spark, sf_dir).where(F.col(COPIES) > 1).select("table_name", *MESSAGE_KEYS)


def p7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each message, with the number of its deliveries; the messages whole are in p7_<table>."""
    return message_copies(spark, sf_dir).select("table_name", *MESSAGE_KEYS, F.col(COPIES).alias("copies"))


def _whole(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return message_rows(spark, sf_dir, name).select(*table(spark, sf_dir, name).columns, F.col(COPIES).alias("copies"))


def p7_shopify_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one copy of each message of shopify_customers with all its columns."""
    return _whole(spark, sf_dir, "shopify_customers")


def p7_mailchimp_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one copy of each message of mailchimp_subscribers with all its columns."""
    return _whole(spark, sf_dir, "mailchimp_subscribers")


def p7_incremental_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one copy of each message of incremental_watermarks with all its columns."""
    return _whole(spark, sf_dir, "incremental_watermarks")


def source_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time texts of the source tables with their sender's zone and date order (source_zones is a fixed table of
    a row a sender, small enough to broadcast after a check of its size)."""
    fields = [("shopify_customers_source", "accepts_marketing_updated_at", "_source"), ("mailchimp_subscribers_source", "timestamp_signup", "list_id"), ("mailchimp_subscribers_source", "last_changed", "list_id")]
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source_table"), "kafka_offset", F.lit(f).alias("field"), F.col(f).alias("value"), F.col(o).alias("origin")) for t, f, o in fields]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    zones = table(spark, sf_dir, "source_zones").dropDuplicates(["origin"]).select("origin", "tz_name", F.lower("date_order").alias("date_order"))
    zones = F.broadcast(zones) if zones.limit(10_001).count() <= 10_000 else zones
    return rows.join(zones, "origin", "left").withColumn("series", F.concat_ws("/", "source_table", "field", "origin"))


TIME_KEYS = ["source_table", "kafka_offset", "field"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value that names an instant, in microseconds since 1970 UTC."""
    return normalise(source_times(spark, sf_dir), "value", "tz_name", "date_order", "series", "kafka_offset", "value", TIME_KEYS)


def p6_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of senders whose date order is not known: the path over each sender's records tells it."""
    times = source_times(spark, sf_dir).withColumn("date_order", F.lit(None).cast("string"))
    return normalise(times, "value", "tz_name", "date_order", "series", "kafka_offset", "value", TIME_KEYS)


def p6_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: values with several interpretations where no date order is declared, and how many of them the path and
    the cheapest interpretation of each value by itself get right."""
    times = source_times(spark, sf_dir)
    right = saved(p6_found(spark, sf_dir), "p6-right")
    alone = saved(candidates(times.withColumn("date_order", F.lit(None).cast("string")), "value", "tz_name", "date_order").drop("value", "origin"), "p6-alone")
    alone = alone.where(F.size("candidates") > 1).select(*TIME_KEYS, F.get("candidates", F.lit(0))["us"].alias("cheapest"))
    both = alone.join(right, TIME_KEYS).join(p6_undeclared(spark, sf_dir).withColumnRenamed("utc_us", "by_path"), TIME_KEYS)
    hits = lambda c: F.coalesce(F.sum((F.col(c) == F.col("utc_us")).cast("bigint")), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("ambiguous"), hits("by_path").alias("right_by_path"), hits("cheapest").alias("right_by_cheapest"))
