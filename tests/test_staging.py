import json

from pyspark.sql import functions as F

from tributary.functions import exprs
from tributary.operators.staging import SPECS, stage


def test_all_specs_stage_sparse_rows(spark):
    """Every source takes a row of nulls and of malformed values, and lets no plain identifier through."""
    raw = {
        "shopify_orders": "id bigint, order_number bigint, customer string, email string, phone string, subtotal_price string, total_discounts string, total_tax string, total_price string, total_shipping_price_set string, line_items string, discount_codes string, cancelled_at string, shipping_address string, created_at string, updated_at string, _loaded_at timestamp",
        "shopify_customers": "id bigint, email string, first_name string, last_name string, phone string, default_address string, addresses string, total_spent decimal(18,2), orders_count bigint, created_at timestamp, updated_at timestamp, _webhook_topic string, _loaded_at timestamp",
        "stripe_charges": "id string, customer string, amount bigint, amount_captured bigint, amount_refunded bigint, application_fee_amount bigint, currency string, payment_method_details string, billing_details string, outcome string, created bigint, _loaded_at timestamp",
        "stripe_customers": "id string, email string, name string, phone string, address string, balance bigint, created bigint, _loaded_at timestamp",
        "hubspot_contacts": "id string, hs_object_id string, properties string, email string, firstname string, lastname string, phone string, mobilephone string, address string, city string, zip string, country string, company string, jobtitle string, createdate string, _loaded_at timestamp",
        "mailchimp_campaigns": "campaign_id string, campaign_type string, settings string, emails_sent int, open_rate double, click_rate double, send_time string, _loaded_at timestamp",
        "mailchimp_events": "event_id string, campaign_id string, email_address string, action string, timestamp string, location string, _loaded_at timestamp",
        "mailchimp_subscribers": "subscriber_id string, email_address string, merge_fields string, stats string, phone string, sms_status string, timestamp_signup timestamp, last_changed timestamp, _loaded_at timestamp",
        "ga4_events": "client_id string, user_id string, event_name string, event_timestamp bigint, event_date string, traffic_source string, device string, geo string, page_location string, session_id string, engagement_time_ms bigint, _loaded_at timestamp",
    }
    for name, schema in raw.items():
        fields = [f.strip().split(" ") for f in schema.replace("(18,2)", "").split(", ")]
        bad = tuple("{broken" if t == "string" else None for _, t in fields)
        df = spark.createDataFrame([tuple(None for _ in fields), bad, bad], schema)
        out, vault = stage(df, SPECS[name], "p")
        rows = out.collect()
        assert rows, name
        assert not set(SPECS[name].identifiers) & set(out.columns), name
        assert stage(df.limit(0), SPECS[name], "p")[0].count() == 0
        if vault is not None:
            assert all(v.token.startswith("tok_") for v in vault.collect())


def test_values(spark):
    one = spark.range(1)
    first, last = exprs.split_name(F.lit(" Ann Mary Lee "))
    r = one.select(
        first.alias("f"), last.alias("l"), exprs.split_name(F.lit("Ann"))[1].alias("n"), exprs.full_name(F.lit("A"), F.lit(" ")).alias("a"), exprs.full_name(F.lit(None).cast("string"), F.lit("")).alias("none"),
        exprs.json_length(F.lit('[{"a": {}}, {"b": [1]}]')).alias("two"), exprs.json_length(F.lit("x")).alias("zero"), exprs.from_cents(F.lit(1999)).cast("string").alias("c"), exprs.rate(F.lit(1), F.lit(0)).alias("r"),
        exprs.channel_group(F.lit("(direct)"), F.lit(None)).alias("d"), exprs.channel_group(F.lit("g"), F.lit("cpc")).alias("p"), exprs.channel_group(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("o"),
        exprs.iso_time(F.lit("2024-01-01T01:02:03Z")).cast("string").alias("t"), exprs.iso_time(F.lit("x")).alias("bad"),
        exprs.column_or_property(F.lit(" "), F.lit(json.dumps({"k": "v"})), "$.k").alias("k"),
    ).first()
    assert tuple(r) == ("Ann", "Mary Lee", None, "A", None, 2, 0, "19.99", None, "direct", "paid_search", "other", "2024-01-01 01:02:03", None, "v")
