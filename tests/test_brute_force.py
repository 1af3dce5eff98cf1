"""p1 and p6 against plain loops over the smallest tables."""

import datetime as dt
import json
import os
import re
from zoneinfo import ZoneInfo

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def load(text):
    try:
        v = json.loads(text)
        while isinstance(v, str):
            v = json.loads(v)
        return v
    except (TypeError, ValueError):
        return None


def number(x):
    m = re.search(r"(\d+)$", str(x))
    return m and m.group(1)


def addresses(v):
    if isinstance(v, int):
        return [{"id": v}]
    if isinstance(v, list):
        return [a for x in v for a in (addresses(x) if isinstance(x, list) else [x]) if isinstance(a, dict)]
    if not isinstance(v, dict):
        return []
    for key in ("addresses", "edges", "default_address"):
        if key in v:
            inner = v[key]
            return addresses(inner) if key == "addresses" else [e["node"] for e in inner] if key == "edges" else [inner]
    return [v] if "id" in v else [x for x in v.values() if isinstance(x, dict)]


def leaves(v, path=()):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, (*path, k))
    elif v is not None and v != "":
        yield ".".join(path)


def test_p1(spark):
    from tributary.plans.core_problems import p1_found

    want = set()
    for r in spark.read.parquet(f"{SF}/shopify_customers.parquet").collect():
        for a in addresses(load(r.addresses)):
            if number(a.get("id")):
                want.add(("customer", str(r.id), "address", number(a["id"])))
                want |= {("address", number(a["id"]), "contact", str(c["id"])) for c in a.get("contacts") or [] if c and c.get("id") is not None}
        want |= {("customer", str(r.id), "default_address", number(a["id"])) for a in addresses(load(r.default_address)) if number(a.get("id"))}
    for r in spark.read.parquet(f"{SF}/mailchimp_subscribers.parquet").collect():
        who, m, s = r.subscriber_id.lower(), load(r.merge_fields), load(r.stats)
        m = {x["tag"]: x["value"] for x in m} if isinstance(m, list) else m or {}
        m = {k.upper(): x for k, x in m.get("merge_fields", m).items()}
        want |= {("subscriber", who, "interest", i["id"]) for i in m.pop("INTERESTS", None) or []}
        want |= {("subscriber", who, "merge_field", p) for p in leaves(m)}
        want |= {("subscriber", who, "stat", p) for p in leaves((s or {}).get("stats", s or {}))}
    assert {tuple(r) for r in p1_found(spark, SF).collect()} == want


ABBREVIATED = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "PST": -8, "PDT": -7, "BST": 1, "CET": 1, "CEST": 2, "AEST": 10, "AEDT": 11}
FORMS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y/%m/%d %H:%M:%S", "%Y%m%dT%H%M%S", "%a, %d %b %Y %H:%M:%S", "%b %d, %Y %I:%M %p", "%Y-%m-%d"]


def instant(text, zone, order):
    text = (text or "").strip()
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", text):
        return int(text) * 10 ** (16 - len(text))
    m = re.fullmatch(r"(.*?)\s*(Z|[+-]\d\d:?\d\dZ?|\[.*\]|[A-Z]{3,4})?", text)
    body, z = (text, None) if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else m.groups()
    forms = FORMS + [f"%{a}{c}%{b}{c}%Y {t}" for c in "/.-" for t in ("%H:%M", "%I:%M %p") for a, b in (["md", "dm"][order == "dmy"],)]
    for form in forms:
        try:
            t = dt.datetime.strptime(body, form)
        except ValueError:
            continue
        if z is None or z[0] == "[":
            t = t.replace(tzinfo=ZoneInfo(z[1:-1] if z else zone), fold=0)
        elif z in ABBREVIATED or z[0] == "Z":
            t = t.replace(tzinfo=dt.timezone(dt.timedelta(hours=ABBREVIATED.get(z, 0))))
        else:
            d = re.sub(r"\D", "", z)
            t = t.replace(tzinfo=dt.timezone((1 if z[0] == "+" else -1) * dt.timedelta(hours=int(d[:2]), minutes=int(d[2:]))))
        return (t.astimezone(dt.timezone.utc) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return None


def test_p6(spark):
    from tributary.plans.core_problems import p6_found

    zones = {r.origin: (r.tz_name, r.date_order) for r in spark.read.parquet(f"{SF}/source_zones.parquet").collect()}
    want = {}
    for table, fields, origin in (("shopify_customers_source", ["accepts_marketing_updated_at"], "_source"), ("mailchimp_subscribers_source", ["timestamp_signup", "last_changed"], "list_id")):
        for r in spark.read.parquet(f"{SF}/{table}.parquet").collect():
            for f in fields:
                us = instant(r[f], *zones[r[origin]])
                if us is not None:
                    want[table, r.kafka_offset, f] = us
    rows = p6_found(spark, SF).collect()
    assert len(rows) == len(want) and {(r.source_table, r.kafka_offset, r.field): r.utc_us for r in rows} == want
