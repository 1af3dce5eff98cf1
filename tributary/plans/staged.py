"""Staging of the seven sources that have no table of their own among the driver's: raw frames in the sources' shapes
are made of the star schema, staged by their specs in batch or as a stream, and held against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.exprs import rate
from tributary.operators import staging
from tributary.plans.tables import PEPPER
from tributary.session import scratch, table
from tributary.streaming import jobs


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _nested(c: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.struct(*[x.alias(n) for n, x in fields.items()]).alias(c)))


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _list(n: Column) -> Column:
    return F.when(n == 0, "[]").when(n == 1, '["a"]').when(n == 2, '["a","b"]').otherwise("no list")


def _loaded(version: int = 1) -> Column:
    return F.lit(f"2024-06-0{version} 00:00:00").cast("timestamp").alias("_loaded_at")


def raw_shopify_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, key = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), (key % 1000).alias("order_number"), _json(id=F.col("o_custkey")).alias("customer"), F.concat(F.lit(" User"), "o_custkey", F.lit("@Shop.Example ")).alias("email"),
        F.when(key % 5 == 0, "123").otherwise(F.concat(F.lit("+1 (555) "), F.lpad(_text("o_custkey"), 7, "0"))).alias("phone"),
        _text(price).alias("subtotal_price"), F.when(key % 2 == 0, "1.50").otherwise("n/a").alias("total_discounts"), F.lit(None).cast("string").alias("total_tax"), _text(price).alias("total_price"),
        _nested("shop_money", amount=F.lit("4.90")).alias("total_shipping_price_set"), _list(key % 4).alias("line_items"), _list(key % 3).alias("discount_codes"),
        F.when(F.col("o_orderstatus") == "F", _iso(F.col("o_orderdate"))).alias("cancelled_at"), _json(country_code=F.lower(F.substring("o_orderpriority", 3, 2)), city=F.lit(" Bonn ")).alias("shipping_address"),
        _iso(F.col("o_orderdate")).alias("created_at"), F.lit("never").alias("updated_at"), _loaded(),
    )


ORDER_COLUMNS = ["order_id", "order_number", "customer_id", "email_token", "phone_token", "total_price", "total_discounts", "total_tax", "shipping_amount", "line_item_count", "discount_count", "has_discount", "is_cancelled", "shipping_country_code", "shipping_city"]


def _us(*columns: str) -> list[Column]:
    return [F.unix_micros(c).alias(f"{c.removesuffix('_at')}_us") for c in columns]


def staged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = staging.stage(raw_shopify_orders(spark, sf_dir), staging.SPECS["shopify_orders"], PEPPER)
    return out.select(*ORDER_COLUMNS, *_us("created_at", "updated_at"))


def stream_staged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spec on a stream of the same rows landed as Parquet: a stateless transform with a checkpoint."""
    raw, out = scratch(spark, "orders-raw"), scratch(spark, "orders-staged")
    rows = raw_shopify_orders(spark, sf_dir)
    rows.write.parquet(raw)
    stream = spark.readStream.schema(rows.schema).parquet(raw)
    jobs.transformed(stream, lambda s: staging.stage(s, staging.SPECS["shopify_orders"], PEPPER, deduplicate=False, vault=False)[0], out, scratch(spark, "orders-check")).awaitTermination()
    return spark.read.parquet(out).select(*ORDER_COLUMNS, *_us("created_at", "updated_at"))


def raw_stripe_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    supplier = F.col("l_suppkey")
    card = F.struct(F.element_at(F.array(*map(F.lit, ("visa", "amex", "jcb"))), (supplier % 3 + 1).cast("int")).alias("brand"), F.lpad(_text(supplier % 10000), 4, "0").alias("last4"), F.lit("credit").alias("funding"), _text(supplier % 12 + 1).alias("exp_month"), F.lit("DE").alias("country"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("ch_"), "l_orderkey", F.lit("_"), "l_linenumber").alias("id"), F.concat(F.lit("cus_"), "l_suppkey").alias("customer"), cents.alias("amount"),
        F.when(F.col("l_linestatus") == "O", cents).otherwise(0).alias("amount_captured"), F.when(F.col("l_returnflag") == "R", cents).otherwise(0).alias("amount_refunded"), F.lit(None).cast("bigint").alias("application_fee_amount"),
        F.lit("usd").alias("currency"), F.to_json(F.struct(card.alias("card"))).alias("payment_method_details"), _json(email=F.concat(F.lit("Pay"), "l_suppkey", F.lit("@x.example"))).alias("billing_details"),
        _json(risk_level=F.lit("normal"), risk_score=_text("l_linenumber")).alias("outcome"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("created"), _loaded(),
    )


def _staged_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage(raw_stripe_charges(spark, sf_dir), staging.SPECS["stripe_charges"], PEPPER)[0]


def staged_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged_charges(spark, sf_dir).select("charge_id", "customer_id", "amount", "amount_captured", "amount_refunded", "application_fee_amount", "currency", "card_brand", "card_last4", "card_exp_month", "card_country", "email_token", "risk_score", "is_refunded", *_us("created_at"))


def raw_stripe_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, "Cher").when(key % 4 == 1, F.concat(F.lit(" Ann  "), F.lit("Lee"), _text(key))).when(key % 4 == 2, " ").otherwise(F.concat(F.lit("Jo van Dyk"), _text(key)))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cus_"), "c_custkey").alias("id"), F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit("C"), "c_custkey", F.lit("@Y.example"))).alias("email"), name.alias("name"), F.lit("12").alias("phone"),
        _json(line1=F.lit("1 High St"), city=F.col("c_mktsegment"), postal_code=_text(key % 100), country=F.lit("gb")).alias("address"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("balance"), (key * 86400).alias("created"), _loaded(),
    )


def staged_stripe_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = staging.stage(raw_stripe_customers(spark, sf_dir), staging.SPECS["stripe_customers"], PEPPER)
    return out.select("customer_id", "email_token", "first_name_token", "last_name_token", "full_name_token", "phone_token", "address_line1_token", "city", "postal_code", "country", "balance", *_us("created_at"))


def raw_hubspot_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third contact has its e-mail only among its properties, every seventh its id only as hs_object_id, and
    every thirty-fifth no id at all."""
    key = F.col("c_custkey")
    none = F.lit(None).cast("string")
    mail = F.concat(F.lit("H"), "c_custkey", F.lit("@Hub.example"))
    return table(spark, sf_dir, "customer").select(
        F.when(key % 7 != 0, _text(key)).alias("id"), F.when((key % 7 == 0) & (key % 5 != 0), _text(key + 1_000_000)).alias("hs_object_id"), F.when(key % 3 != 0, mail).otherwise("  ").alias("email"),
        F.lit("Ada").alias("firstname"), F.col("c_name").alias("lastname"), *[none.alias(c) for c in ("phone", "mobilephone", "address", "city", "zip", "country", "company", "jobtitle")], none.alias("createdate"),
        F.when(key % 2 == 0, _json(email=mail, company=F.col("c_mktsegment"), city=F.lit("Rome"), mobilephone=F.lit("0039 06 1234567"), createdate=F.lit("2024-02-03T04:05:06Z"))).otherwise("{broken").alias("properties"), _loaded(),
    )


def staged_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = staging.stage(raw_hubspot_contacts(spark, sf_dir), staging.SPECS["hubspot_contacts"], PEPPER)
    return out.select("contact_id", "email_token", "first_name_token", "last_name_token", "full_name_token", "mobile_phone_token", "city", "company", *_us("created_at"))


def raw_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("c"), (key % 50).cast("string"), F.lit("-"), "p_partkey").alias("campaign_id"), F.lit(" Regular").alias("campaign_type"), _json(subject_line=F.col("p_name"), from_name=F.col("p_brand")).alias("settings"),
        F.col("p_size").alias("emails_sent"), F.when(key % 2 == 0, "0.25").otherwise("often").alias("open_rate"), F.lit("0.031").alias("click_rate"), F.lit("2024-05-06T07:08:09Z").alias("send_time"), _loaded(),
    )


def staged_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = staging.stage(raw_campaigns(spark, sf_dir), staging.SPECS["mailchimp_campaigns"], PEPPER)
    return out.select("campaign_id", "campaign_type", "subject", "from_name", "emails_sent", "open_rate", "click_rate", *_us("send_time"))


def raw_email_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        _text("event_id").alias("event_id"), F.concat(F.lit("c"), F.col("user_id") % 50).alias("campaign_id"), F.concat(F.lit("U"), "user_id", F.lit("@X.example")).alias("email_address"),
        F.when(kind == "error", "Bounce").otherwise(F.upper(kind)).alias("action"), _iso(F.col("ts")).alias("timestamp"), _json(country_code=F.lit("FR")).alias("location"), _loaded(),
    )


def _staged_email_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage(raw_email_events(spark, sf_dir), staging.SPECS["mailchimp_events"], PEPPER)[0]


def staged_email_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged_email_events(spark, sf_dir).select("event_id", "campaign_id", "email_token", "action", "event_date", "country_code", "is_bounce", F.unix_micros("event_timestamp").alias("event_us"))


def raw_ga4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event loaded twice; the later load has another medium, which must win."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    source = F.when(kind == "error", "(direct)").otherwise("google")

    def load(version: int, medium: Column) -> DataFrame:
        return e.select(
            F.concat(F.lit("cl"), "user_id").alias("client_id"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("U"), "user_id", F.lit("@X.example"))).alias("user_id"), kind.alias("event_name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("event_timestamp"),
            F.date_format("ts", "yyyyMMdd").alias("event_date"), _json(source=source, medium=medium).alias("traffic_source"), F.to_json(F.struct(F.lit("mobile").alias("category"), F.struct(F.lit("Firefox").alias("browser")).alias("web_info"))).alias("device"),
            _json(country=F.lit("Chile")).alias("geo"), F.concat(F.lit("/p/"), F.col("user_id") % 7).alias("page_location"), F.lit("s1").alias("session_id"), F.lit(5).alias("engagement_time_ms"), _loaded(version),
        )

    medium = F.when(kind == "view", "organic").when(kind == "click", "cpc").when(kind == "signup", "email").otherwise("other")
    return load(1, F.lit("sms")).unionByName(load(2, medium))


def staged_ga4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = staging.stage(raw_ga4_events(spark, sf_dir), staging.SPECS["ga4_events"], PEPPER)
    return out.select("client_id", "user_id_token", "event_name", "event_date", "source", "medium", "channel_group", "device_category", "browser", "geo_country", "page_location", F.unix_micros("event_timestamp").alias("event_us"))


# -- roll-ups over staged rows ------------------------------------------------------------------------------------------


def charges_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and a refund rate of each customer's charges, and the card used most (of equals the first by name)."""
    brands = _staged_charges(spark, sf_dir).groupBy("customer_id", "card_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("a"), F.sum(F.col("is_refunded").cast("bigint")).alias("r"), F.max("created_at").alias("last"))
    n = F.sum("n")
    return brands.groupBy("customer_id").agg(
        n.alias("charges"), F.sum("a").cast("decimal(18,2)").alias("amount"), rate(F.sum("r"), n).alias("refund_rate"), F.min_by("card_brand", F.struct(-F.col("n"), F.col("card_brand"))).alias("preferred_card"), F.unix_micros(F.max("last")).alias("last_charge_us")
    )


def subscriber_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts and latest dates of each address's e-mail events."""
    counts = [F.sum((F.col("action") == a).cast("bigint")).alias(f"{a}s") for a in ("view", "click", "signup", "purchase", "bounce")]
    last = [F.max(F.when(F.col("action") == a, F.col("event_date"))).alias(f"last_{a}") for a in ("view", "click")]
    return _staged_email_events(spark, sf_dir).groupBy("email_token").agg(*counts, *last)


def user_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: events, their value, the latest day, and the shares of two kinds as averages of booleans."""
    share = lambda k: F.round(F.avg(F.when(F.col("event_type") == k, 1.0).otherwise(0.0)), 6).alias(f"{k}_share")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"), F.to_date(F.max("ts")).alias("last_seen"), share("view"), share("purchase"))


def payments_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, paid = F.count(F.lit(1)), F.sum((F.col("amount_captured") > 0).cast("bigint"))
    return _staged_charges(spark, sf_dir).groupBy(F.to_date("created_at").alias("payment_date")).agg(n.alias("charges"), paid.alias("captured"), F.sum("amount").cast("decimal(18,2)").alias("amount"), rate(paid, n).alias("captured_rate"))


def campaign_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign groups with what their events say; groups without events stay with zeros."""
    groups = staged_campaigns(spark, sf_dir).groupBy(F.substring_index("campaign_id", "-", 1).alias("campaign_id")).agg(F.sum("emails_sent").alias("emails_sent"))
    events = _staged_email_events(spark, sf_dir).groupBy("campaign_id").agg(*[F.sum((F.col("action") == a).cast("bigint")).alias(f"{a}s") for a in ("view", "click", "bounce")])
    out = groups.join(events, "campaign_id", "left").fillna(0, ["views", "clicks", "bounces"])
    return out.withColumn("click_rate", rate(F.col("clicks"), F.col("views"))).withColumn("bounce_rate", rate(F.col("bounces"), F.col("emails_sent")))


NAMES = [
    "staged_orders", "stream_staged_orders", "staged_charges", "staged_stripe_customers", "staged_contacts", "staged_campaigns", "staged_email_events", "staged_ga4_events",
    "charges_per_customer", "subscriber_actions", "user_behaviour", "payments_daily", "campaign_performance",
]
QUERIES = {n: globals()[n] for n in NAMES}
