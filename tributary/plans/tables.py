"""Queries of the reference's table operators, on the driver's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.exprs import date_parts, money, rate
from tributary.operators import entity, pii, staging, windows
from tributary.operators.incremental import recompute_touched
from tributary.operators.skew import lookup_join
from tributary.sources.lake import LakeTable
from tributary.session import saved, scratch, table
from tributary.streaming import jobs

AS_OF = datetime.date(2001, 8, 1)
#: The pepper of these queries over test tables; the operators take their own as a parameter.
PEPPER = "pepper-of-the-tests"
SIX_HOURS = 6 * 3600


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("order_date", F.to_date("o_orderdate"))


def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day, nation and priority; customer and nation are joined by the planner's choice."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = _orders(spark, sf_dir).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    n = F.count(F.lit(1))
    finished = F.sum((F.col("o_orderstatus") == "F").cast("bigint"))
    return rows.groupBy("order_date", "n_name", "o_orderpriority").agg(
        n.alias("total_orders"),
        F.count_distinct("o_custkey").alias("customers"),
        money(F.sum(money("o_totalprice"))).alias("revenue"),
        finished.alias("finished_orders"),
        rate(finished, n).alias("finished_rate"),
    )


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.to_date(F.min("o_orderdate")).alias("first_order"),
        F.to_date(F.max("o_orderdate")).alias("last_order"),
        money(F.min_by("o_totalprice", at)).alias("first_value"),
        money(F.max_by("o_totalprice", at)).alias("last_value"),
        money(F.sum(money("o_totalprice"))).alias("total_spent"),
    )


def customer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their order statistics; first and last values by time, zero orders for those without."""
    c = lookup_join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), customer_orders(spark, sf_dir), "c_custkey")
    days = F.datediff("last_order", "first_order")
    return c.select(
        "c_custkey", "c_mktsegment", F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"), "first_order", "last_order", "first_value", "last_value", "total_spent",
        F.datediff(F.lit(AS_OF), "last_order").alias("days_since_last"),
        F.when(F.col("orders") > 1, rate(days, F.col("orders") - 1, 2)).alias("order_frequency_days"),
    )


def payment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by month of shipping, flag and status, with a rate of returns."""
    n, back = F.count(F.lit(1)), F.sum((F.col("l_returnflag") == "R").cast("bigint"))
    rows = table(spark, sf_dir, "lineitem").withColumn("month_key", F.date_format("l_shipdate", "yyyy-MM"))
    return rows.groupBy("month_key", "l_linestatus").agg(
        n.alias("lines"), money(F.sum(money("l_extendedprice"))).alias("amount"), back.alias("returned"), rate(back, n).alias("return_rate"), money(F.max(money("l_extendedprice"))).alias("largest")
    )


def campaign_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind by day in one conditional aggregation, with guarded rates."""
    kinds = ("view", "click", "signup", "purchase", "error")
    counts = [F.sum((F.col("event_type") == k).cast("bigint")).alias(f"{k}s") for k in kinds]
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("event_date")).agg(*counts)
    c = F.col
    return daily.select(
        "*", rate(c("clicks"), c("views")).alias("click_rate"), rate(c("purchases"), c("clicks")).alias("purchase_rate"), rate(c("errors"), c("views") + c("clicks")).alias("error_rate")
    )


def events_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, the second time later and with another value: the later one stays."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "event_id", "value")
    first = e.withColumn("loaded", F.lit(1))
    again = e.withColumn("loaded", F.lit(2)).withColumn("value", F.col("value") + 1)
    return windows.latest_per_key(first.unionByName(again), ["user_id", "ts", "event_type"], ["loaded", "event_id"])


def _sessions(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    measures = {"events": F.count(F.lit(1)), "views": F.sum((F.col("event_type") == "view").cast("bigint")), "purchases": F.sum((F.col("event_type") == "purchase").cast("bigint"))}
    s = windows.sessions(table(spark, sf_dir, "events"), "user_id", "ts", gap, "event_id", ["event_type"], ["event_type"], measures)
    engaged = (F.col("views") >= 2) | (F.col("purchases") > 0)
    return s.withColumn("is_engaged", engaged).withColumn("is_bounce", (F.col("events") <= 1) & ~engaged)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, 1800)


def sessions_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, SIX_HOURS)


def _engagement(s: DataFrame, *by) -> DataFrame:
    n, engaged, bounced = F.count(F.lit(1)), F.sum(F.col("is_engaged").cast("bigint")), F.sum(F.col("is_bounce").cast("bigint"))
    return s.groupBy(*by).agg(
        n.alias("sessions"), F.count_distinct("user_id").alias("users"), F.sum("events").alias("events"), F.sum("purchases").alias("purchases"),
        rate(engaged, n).alias("engagement_rate"), rate(bounced, n).alias("bounce_rate"), rate(F.sum("purchases"), n).alias("conversion_rate"),
    )


def engagement_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engagement(sessions_6h(spark, sf_dir), F.to_date("session_start").alias("session_date"))


def engagement_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engagement(sessions_6h(spark, sf_dir), F.to_date("session_start").alias("session_date"), F.col("first_event_type").alias("channel"))


def page_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their session's ends: how often a kind of event was an entrance or an exit."""
    e = windows.with_sessions(table(spark, sf_dir, "events"), "user_id", "ts", SIX_HOURS, "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("_first", ~F.col("sess_num").eqNullSafe(F.lag("sess_num").over(w))).withColumn("_last", ~F.col("sess_num").eqNullSafe(F.lead("sess_num").over(w)))
    entrances, exits = F.sum(F.col("_first").cast("bigint")), F.sum(F.col("_last").cast("bigint"))
    return e.groupBy(F.to_date("ts").alias("event_date"), "event_type").agg(F.count(F.lit(1)).alias("events"), entrances.alias("entrances"), exits.alias("exits"), rate(exits, F.count(F.lit(1))).alias("exit_rate"))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("event_date", F.to_date("ts"))
    return windows.funnel(e, ["user_id"], "event_date", "event_type", ["view", "click", "signup", "purchase"])


def _daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).groupBy("order_date").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"), money(F.sum(money("o_totalprice"))).alias("revenue"))


def sales_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sales with calendar columns, the day's leading nation and means of 7 and 30 rows."""
    daily = _daily_sales(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    by_nation = _orders(spark, sf_dir).join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("order_date", "n_name").agg(F.sum(money("o_totalprice")).alias("r"))
    top = windows.top_n_per_group(by_nation, ["order_date"], [F.desc("r"), F.col("n_name")], 1).select("order_date", F.col("n_name").alias("top_nation"))
    out = daily.join(top, "order_date", "left").select("*", *[e.alias(n) for n, e in date_parts(F.col("order_date")).items()])
    for k in (7, 30):
        out = windows.rolling_mean(out, "orders", "order_date", k, f"orders_mean_{k}").withColumn(f"orders_mean_{k}", F.round(f"orders_mean_{k}", 4))
    return out


def sales_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("order_date")
    d = _daily_sales(spark, sf_dir).withColumn("previous_day", F.lag("revenue", 1).over(w)).withColumn("previous_week", F.lag("revenue", 7).over(w))
    return d.select("order_date", "revenue", "previous_day", "previous_week", rate(F.col("revenue") - F.col("previous_day"), F.col("previous_day")).alias("growth_day"), rate(F.col("revenue") - F.col("previous_week"), F.col("previous_week")).alias("growth_week"))


def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month, quarter and year to date in one scan: each order is counted in the periods it belongs to."""
    d, as_of = F.col("order_date"), F.lit(AS_OF)
    periods = F.array(*[F.when(d >= F.trunc(as_of, p), F.lit(n)) for n, p in (("MTD", "month"), ("QTD", "quarter"), ("YTD", "year"))])
    rows = _orders(spark, sf_dir).where(d <= as_of).select("o_custkey", "o_totalprice", F.explode(F.filter(periods, lambda x: x.isNotNull())).alias("period_type"))
    n, revenue = F.count(F.lit(1)), F.sum(money("o_totalprice"))
    return rows.groupBy("period_type").agg(n.alias("orders"), F.count_distinct("o_custkey").alias("customers"), money(revenue).alias("revenue"), rate(revenue, n, 2).alias("order_value"))


def engagement_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily engagement with the day's leading channel and a mean of seven rows."""
    s = saved(sessions_6h(spark, sf_dir).withColumn("session_date", F.to_date("session_start")), "dashboard-sessions")
    by_channel = s.groupBy("session_date", "first_event_type").count()
    top = windows.top_n_per_group(by_channel, ["session_date"], [F.desc("count"), F.col("first_event_type")], 1).select("session_date", F.col("first_event_type").alias("top_channel"))
    pivot = [F.sum((F.col("first_event_type") == k).cast("bigint")).alias(f"from_{k}") for k in ("view", "click", "purchase")]
    daily = s.groupBy("session_date").agg(F.count(F.lit(1)).alias("sessions"), *pivot).join(top, "session_date", "left")
    return windows.rolling_mean(daily, "sessions", "session_date", 7, "sessions_mean_7").withColumn("sessions_mean_7", F.round("sessions_mean_7", 4))


def customer_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with what orders, line items and events say of them; each side is aggregated before its join."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("returned_lines"))
    ev = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("events"), F.to_date(F.max("ts")).alias("last_seen"))
    out = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for side in (customer_orders(spark, sf_dir).select("c_custkey", "orders", "total_spent"), lines, ev):
        out = out.join(side, "c_custkey", "left")
    flags = [F.col(c).isNotNull().cast("int") for c in ("orders", "returned_lines", "events")]
    return out.withColumn("source_count", flags[0] + flags[1] + flags[2])


def tokenized_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.tokenize_frame(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": "name"}, PEPPER)[0]


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.tokenize_frame(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": "name"}, PEPPER)[1]


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as two sources; the key they share is nation and the end of the number."""
    token = lambda nation, key: F.concat_ws("-", F.col(nation).cast("string"), (F.col(key) % 100).cast("string"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").cast("string").alias("source_id"), token("c_nationkey", "c_custkey").alias("email_token"), F.col("c_custkey").alias("staged_at"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").cast("string").alias("source_id"), token("s_nationkey", "s_suppkey").alias("email_token"), F.col("s_suppkey").alias("staged_at"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return c.unionByName(s)


def entity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.resolve_exact(_profiles(spark, sf_dir))


def blocking_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiles(spark, sf_dir)
    return entity.blocking_keys(p, {"email": F.col("email_token"), "name_zip": F.concat_ws("_", F.lower(F.substring("name", 1, 3)), F.col("nation"))})


def entity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.quality(entity_exact(spark, sf_dir))


def entity_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.cardinality_histogram(entity_exact(spark, sf_dir))


def entity_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers that agree in the token, or in the nation and the number's last three digits."""
    p = _profiles(spark, sf_dir).withColumn("tail", F.concat_ws("-", "nation", F.substring("name", -3, 3)))
    left = p.where("source = 'supplier'").select(F.col("source_id").alias("l_id"), F.col("email_token").alias("l_token"), F.col("tail").alias("l_tail"))
    right = p.where("source = 'customer'").select(F.col("source_id").alias("r_id"), F.col("email_token").alias("r_token"), F.col("tail").alias("r_tail"))
    return entity.blocked_pairs(left, right, "l_id", "r_id", [(F.col("l_token"), F.col("r_token")), (F.col("l_tail"), F.col("r_tail"))])


def entity_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best customer of each supplier among blocked pairs, by name and address similarity."""
    p = _profiles(spark, sf_dir).select("source", "source_id", "name", "email_token")
    left = p.where("source = 'supplier'").select(F.col("source_id").alias("l_id"), F.col("name").alias("l_name"), F.col("email_token").alias("l_address"))
    right = p.where("source = 'customer'").select(F.col("source_id").alias("r_id"), F.col("name").alias("r_name"), F.col("email_token").alias("r_address"))
    pairs = entity_blocked_pairs(spark, sf_dir).join(left, "l_id").join(right, "r_id")
    return entity.fuzzy_matches(pairs, "l_id", "r_id", threshold=0.5)


def golden_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer of core_customers: per field the first value, matched best and latest first, of equals the
    smallest."""
    fields = ["city", "country_code", "company", "job_title", "currency"]
    order = [-F.coalesce(F.col("match_confidence"), F.lit(0)).cast("double"), -F.unix_micros("updated_at")]
    return entity.golden_record(table(spark, sf_dir, "core_customers").where("customer_id is not null"), "customer_id", order, fields)


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's latest purchase at that time or before."""
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("purchase_ts"), F.col("event_id").alias("purchase_id"))
    return windows.asof_join(e.select("event_id", "user_id", "ts"), bought, "user_id", "ts", "purchase_ts", ["purchase_id"], "purchase_id")


def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


def semi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


def _base_and_delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", money("o_totalprice").alias("o_totalprice"))
    base = o.where("o_orderkey % 3 <> 0")
    delta = o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("X"))
    return base, delta


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = LakeTable(spark, scratch(spark, "merge"))
    base, delta = _base_and_delta(spark, sf_dir)
    t.replace(base)
    t.merge_upsert(delta, ["o_orderkey"])
    return t.read()


def merge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = LakeTable(spark, scratch(spark, "insert"))
    base, delta = _base_and_delta(spark, sf_dir)
    t.replace(base)
    t.merge_insert(delta, ["o_orderkey"])
    return t.read()


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each version after a replace, an upsert, an append and a rollback to the first."""
    t = LakeTable(spark, scratch(spark, "travel"))
    base, delta = _base_and_delta(spark, sf_dir)
    t.replace(base)
    t.merge_upsert(delta, ["o_orderkey"])
    t.append(base)
    t.rollback(1)
    counts = [t.read(v).groupBy(F.lit(v).alias("version")).agg(F.count(F.lit(1)).alias("rows")) for v in t.versions()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue, first of two thirds of the orders, then of the partitions the rest touches."""
    o = _orders(spark, sf_dir).withColumn("month_key", F.date_format("order_date", "yyyy-MM"))
    build = lambda df: df.groupBy("month_key").agg(F.count(F.lit(1)).alias("orders"), money(F.sum(money("o_totalprice"))).alias("revenue"))
    t = LakeTable(spark, scratch(spark, "incremental"), "month_key")
    late = o.where("o_orderkey % 3 = 0")
    t.replace(build(o.where("o_orderkey % 3 <> 0")))
    t.overwrite_partitions(recompute_touched(o, late, "month_key", build))
    return t.read()


def _event_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    at = scratch(spark, "landing")
    table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value").write.json(at)
    return at, "event_id BIGINT, ts STRING, user_id BIGINT, event_type STRING, value DOUBLE"


def stream_raw_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed as JSON, streamed into Parquet with a checkpoint, twice: the second run finds nothing new."""
    at, schema = _event_files(spark, sf_dir)
    out, check = scratch(spark, "raw"), scratch(spark, "check")
    for _ in range(2):
        stream = spark.readStream.schema(schema).json(at).withColumn("ts", F.to_timestamp_ntz("ts"))
        jobs.append_raw(stream, out, check).awaitTermination()
    return spark.read.parquet(out)


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind from a stream in complete mode, into a table of the store."""
    at, schema = _event_files(spark, sf_dir)
    stream = spark.readStream.schema(schema).json(at).withColumn("ts", F.to_timestamp("ts"))
    t = LakeTable(spark, scratch(spark, "window-counts"))
    jobs.replaced(jobs.window_counts(stream, "ts", "1 day", "1 hour", "event_type"), t, scratch(spark, "check")).awaitTermination()
    return t.read().select(F.to_date("window_start").alias("event_date"), "event_type", "events")


def bench_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("orders"), money(F.sum(money("o_totalprice"))).alias("revenue"))


def bench_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


def bench_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), money(F.sum(money("o_totalprice"))).alias("revenue")).orderBy(F.desc("revenue"), "n_name").limit(10)


def bench_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("order_date")
    return _daily_sales(spark, sf_dir).select("order_date", "revenue", money(F.sum("revenue").over(w)).alias("running_revenue"))


def null_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.null_rates(table(spark, sf_dir, "core_customers").select("email_token", "city", "country_code", "match_confidence"))


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table, from one small aggregate a table."""
    names = ("orders", "lineitem", "events", "core_orders", "entity_index")
    out = None
    for n in names:
        one = table(spark, sf_dir, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "user_id").limit(20)


def replacing_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each watermark key, as a replacing store would keep it."""
    w = table(spark, sf_dir, "incremental_watermarks").select("source_table", "pipeline_name", F.unix_micros("updated_at").alias("updated_us"), "records_processed")
    return windows.latest_per_key(w, ["source_table", "pipeline_name"], ["updated_us"])


def summing_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "incremental_watermarks")
    return w.groupBy("source_table", "status").agg(F.sum("records_processed").alias("records"), F.sum("bytes_processed").alias("bytes"))


def median_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 4).alias("median_value"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's rows that the entity index has matched to an earlier entity, nulls as 'unknown'."""
    i = table(spark, sf_dir, "entity_index").select(F.coalesce("source", F.lit("unknown")).alias("source"), (F.col("match_type") != "new_entity").cast("bigint").alias("m"))
    return i.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), rate(F.sum("m"), F.count(F.lit(1))).alias("matched_rate"))


def staged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shopify_customers staged and tokenised; one row a raw message."""
    out, _ = staging.stage(table(spark, sf_dir, "shopify_customers"), staging.SPECS["shopify_customers"], PEPPER)
    return out.select("customer_id", "email_token", "phone_token", "address_count", "total_spent", F.unix_micros("updated_at").alias("updated_us"), "_webhook_topic")


def staged_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mailchimp_subscribers staged: the columns of the latest load of each."""
    out, _ = staging.stage(table(spark, sf_dir, "mailchimp_subscribers"), staging.SPECS["mailchimp_subscribers"], PEPPER)
    return out.select("subscriber_id_token", "email_token", "has_sms", F.unix_micros("_loaded_at").alias("loaded_us"), F.unix_micros("last_changed").alias("changed_us"), F.unix_micros("signup_timestamp").alias("signup_us"))


NAMES = [
    "order_summary", "customer_metrics", "payment_metrics", "campaign_metrics", "events_dedup", "sessions", "sessions_6h", "engagement_daily",
    "engagement_by_channel", "page_performance", "funnel", "sales_dashboard", "sales_growth", "executive_summary", "engagement_dashboard",
    "customer_360", "tokenized_customers", "vault", "entity_exact", "blocking_index", "entity_quality", "entity_cardinality",
    "entity_blocked_pairs", "entity_fuzzy", "golden_customers", "json_extract", "asof_join", "anti_join", "semi_lookup", "merge_upsert",
    "merge_insert", "time_travel", "incremental_equals_full", "stream_raw_append", "stream_window_counts", "bench_simple", "bench_filter",
    "bench_join", "bench_analytics", "null_rate", "row_counts", "top_users", "replacing_merge", "summing_merge", "median_value", "coverage",
    "staged_customers", "staged_subscribers",
]
QUERIES = {n: globals()[n] for n in NAMES}
