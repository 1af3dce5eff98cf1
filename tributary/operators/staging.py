"""Staging: raw events to typed, normalised rows, one select a source, tokenised as the last step.

A source is a StagingSpec: output columns as expressions over the raw columns, the natural key by which the latest load
wins, and the identifiers to tokenise. The same spec serves a batch frame and a stream (deduplication apart).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.exprs import channel_group, column_or_property, from_cents, full_name, iso_time, json_length, split_name
from tributary.operators import pii
from tributary.operators.windows import latest_per_key

Columns = Callable[[], dict[str, Column]]


@dataclass(frozen=True)
class StagingSpec:
    name: str
    columns: Columns
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ("_loaded_at",)
    identifiers: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def _j(c: str, path: str) -> Column:
    return F.get_json_object(c, path)


def _lower(c: Column | str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), F.lit(""))


def _time(c: str) -> Column:
    return iso_time(F.col(c).cast("string"))


def _contact(first: str, last: str) -> dict[str, Column]:
    return {"first_name": F.trim(first), "last_name": F.trim(last), "full_name": full_name(F.col(first), F.col(last)), "last_name_prefix": F.trim(last)}


CONTACT = {"email": "email", "first_name": "name", "last_name": "name", "full_name": "name", "phone": "phone", "last_name_prefix": "name_prefix"}


def _shopify_orders() -> dict[str, Column]:
    money = ("subtotal_price", "total_discounts", "total_tax", "total_price")
    return {
        "order_id": F.col("id").cast("string"), "order_number": F.col("order_number"), "customer_id": _j("customer", "$.id"), "email": _lower("email"), "phone": F.col("phone"),
        **{m: F.col(m).try_cast("decimal(18,2)") for m in money},
        "shipping_amount": _j("total_shipping_price_set", "$.shop_money.amount").try_cast("decimal(18,2)"),
        "line_item_count": json_length(F.col("line_items")), "discount_count": json_length(F.col("discount_codes")), "has_discount": json_length(F.col("discount_codes")) > 0,
        "is_cancelled": F.col("cancelled_at").isNotNull(), "shipping_country_code": F.upper(_j("shipping_address", "$.country_code")), "shipping_city": F.trim(_j("shipping_address", "$.city")),
        "created_at": _time("created_at"), "updated_at": _time("updated_at"), "_loaded_at": F.col("_loaded_at"),
    }


def _shopify_customers() -> dict[str, Column]:
    return {
        "customer_id": F.col("id").cast("string"), "email": _lower("email"), **_contact("first_name", "last_name"), "phone": F.col("phone"),
        "city": F.trim(_j("default_address", "$.city")), "zip": F.trim(_j("default_address", "$.zip")), "country_code": F.upper(_j("default_address", "$.country_code")),
        "address_line1": _j("default_address", "$.address1"), "address_count": json_length(F.col("addresses")), "total_spent": F.col("total_spent").cast("decimal(18,2)"), "orders_count": F.col("orders_count"),
        "created_at": F.col("created_at"), "updated_at": F.col("updated_at"), "_webhook_topic": F.col("_webhook_topic"), "_loaded_at": F.col("_loaded_at"),
    }


def _stripe_charges() -> dict[str, Column]:
    cents = ("amount", "amount_captured", "amount_refunded", "application_fee_amount")
    return {
        "charge_id": F.col("id"), "customer_id": F.col("customer"), **{c: from_cents(F.col(c)) for c in cents}, "currency": F.upper("currency"),
        "card_brand": _j("payment_method_details", "$.card.brand"), "card_last4": _j("payment_method_details", "$.card.last4"), "card_funding": _j("payment_method_details", "$.card.funding"),
        "card_exp_month": _j("payment_method_details", "$.card.exp_month").try_cast("int"), "card_country": _j("payment_method_details", "$.card.country"),
        "email": _lower(_j("billing_details", "$.email")), "risk_level": _j("outcome", "$.risk_level"), "risk_score": _j("outcome", "$.risk_score").try_cast("int"),
        "is_refunded": F.coalesce(F.col("amount_refunded") > 0, F.lit(False)), "created_at": F.timestamp_seconds("created"), "_loaded_at": F.col("_loaded_at"),
    }


def _stripe_customers() -> dict[str, Column]:
    first, last = split_name(F.col("name"))
    return {
        "customer_id": F.col("id"), "email": _lower("email"), "first_name": first, "last_name": last, "full_name": F.nullif(F.trim("name"), F.lit("")), "last_name_prefix": last, "phone": F.col("phone"),
        "address_line1": _j("address", "$.line1"), "city": _j("address", "$.city"), "postal_code": _j("address", "$.postal_code"), "country": F.upper(_j("address", "$.country")),
        "balance": from_cents(F.col("balance")), "created_at": F.timestamp_seconds("created"), "_loaded_at": F.col("_loaded_at"),
    }


def _hubspot_contacts() -> dict[str, Column]:
    p = lambda c, path=None: column_or_property(F.col(c), F.col("properties"), f"$.{path or c}")
    return {
        "contact_id": F.coalesce(F.col("id").cast("string"), F.col("hs_object_id").cast("string")), "email": _lower(p("email")), "first_name": F.trim(p("firstname")), "last_name": F.trim(p("lastname")),
        "full_name": full_name(p("firstname"), p("lastname")), "last_name_prefix": F.trim(p("lastname")), "phone": p("phone"), "mobile_phone": p("mobilephone"), "address_line1": p("address"), "city": p("city"), "zip": p("zip"),
        "country": p("country"), "company": p("company"), "job_title": p("jobtitle"), "created_at": iso_time(p("createdate")), "_loaded_at": F.col("_loaded_at"),
    }


def _mailchimp_campaigns() -> dict[str, Column]:
    return {
        "campaign_id": F.col("campaign_id"), "campaign_type": _lower("campaign_type"), "subject": _j("settings", "$.subject_line"), "from_name": _j("settings", "$.from_name"),
        "emails_sent": F.col("emails_sent"), "open_rate": F.col("open_rate").try_cast("decimal(5,4)"), "click_rate": F.col("click_rate").try_cast("decimal(5,4)"), "send_time": _time("send_time"), "_loaded_at": F.col("_loaded_at"),
    }


def _mailchimp_events() -> dict[str, Column]:
    return {
        "event_id": F.col("event_id"), "campaign_id": F.col("campaign_id"), "email": _lower("email_address"), "action": _lower("action"), "event_timestamp": _time("timestamp"), "event_date": F.to_date(_time("timestamp")),
        "country_code": _j("location", "$.country_code"), "is_bounce": F.coalesce(_lower("action") == "bounce", F.lit(False)), "_loaded_at": F.col("_loaded_at"),
    }


def _mailchimp_subscribers() -> dict[str, Column]:
    m = lambda k: _j("merge_fields", f"$.{k}")
    return {
        "subscriber_id": _lower("subscriber_id"), "email": _lower("email_address"), "first_name": F.trim(m("FNAME")), "last_name": F.trim(m("LNAME")), "full_name": full_name(m("FNAME"), m("LNAME")), "last_name_prefix": F.trim(m("LNAME")),
        "phone": column_or_property(F.col("phone"), F.col("merge_fields"), "$.PHONE"), "avg_open_rate": _j("stats", "$.avg_open_rate").try_cast("decimal(5,4)"), "avg_click_rate": _j("stats", "$.avg_click_rate").try_cast("decimal(5,4)"),
        "has_sms": F.coalesce(F.col("sms_status") == "subscribed", F.lit(False)), "signup_timestamp": F.col("timestamp_signup"), "last_changed": F.col("last_changed"), "_loaded_at": F.col("_loaded_at"),
    }


def _ga4_events() -> dict[str, Column]:
    return {
        "client_id": F.col("client_id"), "user_id": _lower("user_id"), "event_name": F.col("event_name"), "event_timestamp": F.timestamp_micros("event_timestamp"), "event_date": F.to_date(F.try_to_timestamp("event_date", F.lit("yyyyMMdd"))),
        "source": _j("traffic_source", "$.source"), "medium": _j("traffic_source", "$.medium"), "channel_group": channel_group(_j("traffic_source", "$.source"), _j("traffic_source", "$.medium")),
        "device_category": _j("device", "$.category"), "browser": _j("device", "$.web_info.browser"), "geo_country": _j("geo", "$.country"), "page_location": F.col("page_location"), "session_id": F.col("session_id"),
        "engagement_time_ms": F.col("engagement_time_ms"), "_loaded_at": F.col("_loaded_at"),
    }


SPECS = {
    s.name: s
    for s in (
        StagingSpec("shopify_orders", _shopify_orders, identifiers={"email": "email", "phone": "phone"}),
        StagingSpec("shopify_customers", _shopify_customers, identifiers=CONTACT | {"address_line1": "address"}),
        StagingSpec("stripe_charges", _stripe_charges, identifiers={"email": "email"}),
        StagingSpec("stripe_customers", _stripe_customers, identifiers=CONTACT | {"address_line1": "address"}),
        StagingSpec("hubspot_contacts", _hubspot_contacts, identifiers=CONTACT | {"mobile_phone": "phone", "address_line1": "address"}, required=("contact_id",)),
        StagingSpec("mailchimp_campaigns", _mailchimp_campaigns),
        StagingSpec("mailchimp_events", _mailchimp_events, identifiers={"email": "email"}),
        StagingSpec("mailchimp_subscribers", _mailchimp_subscribers, keys=("subscriber_id",), order=("_loaded_at", "last_changed"), identifiers=CONTACT | {"subscriber_id": "mailchimp_id"}),
        StagingSpec("ga4_events", _ga4_events, keys=("client_id", "event_timestamp", "event_name"), identifiers={"user_id": "email"}),
    )
}


def stage(raw: DataFrame, spec: StagingSpec, pepper: str, deduplicate: bool = True, vault: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(staged rows, vault rows). Rows without a required column are left out; of one key the latest load stays.
    A stream is staged with neither deduplication nor vault, which aggregate.
    Missing or malformed values are null, never an error. No plain identifier leaves this function."""
    out = raw.select(*[e.alias(n) for n, e in spec.columns().items()])
    for c in spec.required:
        out = out.where(F.col(c).isNotNull())
    if deduplicate and spec.keys:
        out = latest_per_key(out, list(spec.keys), list(spec.order))
    return pii.tokenize_frame(out, spec.identifiers, pepper) if vault else (pii.tokens_only(out, spec.identifiers, pepper), None)
