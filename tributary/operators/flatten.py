"""Flattening of nested semi-structured records into related flat tables.

The JVM parses each JSON text into a typed nested column, by the shape that its first characters show (an object is
tried as one record first and as a map of records if it is none). From there on nothing is parsed or visited by row,
but for leaves nested deeper than the levels that are unrolled in the plan (open_leaves). Each Arrow batch is flattened over its buffers: the offsets of a list array give the parent index of every child
(list_parent_indices), the child array is the list's own values buffer, and the keys of the parents reach the
children by a vectorised take.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNumericLeadingZeros": "false"}
MAX_DEPTH = 3

CONTACT = "struct<id:string,type:string,value:string>"
ADDRESS_FIELDS = (
    "id:string,first_name:string,last_name:string,company:string,address1:string,address2:string,city:string,"
    "zip:string,country:string,country_code:string,phone:string"
)
ADDRESS = f"struct<{ADDRESS_FIELDS},contacts:array<{CONTACT}>>"


def staged(df: DataFrame, name: str, *steps: Callable[[Column], Column]) -> DataFrame:
    """Applies the steps to a column one projection at a time. Composed in one expression they would repeat each
    other's trees; as projections each result is computed once."""
    for step in steps:
        df = df.withColumn(name, step(F.col(name)))
    return df


def _unquoted(t: Column) -> Column:
    return F.when(t.startswith('"') & t.endswith('"'), F.regexp_replace(F.get_json_object(t, "$"), r"^\s+|\s+$", "")).otherwise(t)


def _closed(t: Column) -> Column:
    return F.when(t.rlike(r"(?s)^(\{.*\}|\[.*\]|-?\d+(\.\d+)?([eE][+-]?\d+)?)$"), t)


#: Steps to the JSON text of a column: out of up to four string encodings, and null unless it is closed (a text cut
#: off in the middle is not closed, and the parser's own failure on it gives null anyway).
JSON_TEXT = (lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), _unquoted, _unquoted, _unquoted, _unquoted, _closed)


def bare_digits(c: Column) -> Column:
    """Digits of an id written as a number, a numeric text or the end of a gid:// reference; null otherwise."""
    d = F.regexp_extract(c, r"^\s*(?:gid://[^?]*/)?0*(\d+)(?:\.0+)?(?:\?.*)?\s*$", 1)
    return F.when(d != "", d)


def _addresses(t: Column) -> Column:
    """array<ADDRESS> from a JSON text of varied shape: a list, a list in a list, one object, an object of objects
    under their ids, {"addresses": [...]}, {"default_address": {...}}, {"edges": [{"node": {...}}]}, or a bare id.
    Null if the text is no valid JSON."""
    names = [f.split(":")[0] for f in ADDRESS_FIELDS.split(",")] + ["contacts"]
    wide = (
        f"struct<addresses:array<{ADDRESS}>,default_address:{ADDRESS},edges:array<struct<node:{ADDRESS}>>,"
        f"{ADDRESS_FIELDS},contacts:array<{CONTACT}>>"
    )
    obj = F.from_json(t, wide, JSON_OPTIONS)
    own = F.struct(*[obj[n].alias(n) for n in names])
    by_id = F.map_values(F.from_json(t, f"map<string,{ADDRESS}>", JSON_OPTIONS))
    from_object = (
        F.when(obj["addresses"].isNotNull(), obj["addresses"])
        .when(obj["edges"].isNotNull(), F.transform(obj["edges"], lambda e: e["node"]))
        .when(obj["default_address"].isNotNull(), F.array(obj["default_address"]))
        .when(obj["id"].isNotNull(), F.array(own))
        .otherwise(by_id)
    )
    empty = {n: F.lit(None).cast("string") for n in names} | {"id": t, "contacts": F.lit(None).cast(f"array<{CONTACT}>")}
    listed = F.from_json(t, f"array<{ADDRESS}>", JSON_OPTIONS)
    nested = F.flatten(F.from_json(t, f"array<array<{ADDRESS}>>", JSON_OPTIONS))
    return (
        F.when(t.startswith("{"), from_object)
        .when(t.rlike(r"^\[\s*\["), nested)
        .when(t.startswith("["), listed)
        .when(t.rlike(r"^\d+$"), F.array(F.struct(*[empty[n].alias(n) for n in names])))
    )


ENTRY = "array<struct<key:string,value:string>>"


def _entries(text: Column) -> Column:
    return F.map_entries(F.from_json(text, "map<string,string>", JSON_OPTIONS)).cast(ENTRY)


def _deeper(entries: Column) -> Column:
    """Each entry whose value is an object is replaced by that object's entries, under joined keys."""

    def one(e: Column) -> Column:
        inner = F.transform(_entries(e["value"]), lambda f: F.struct(F.concat_ws(".", e["key"], f["key"]).alias("key"), f["value"].alias("value")))
        return F.when(e["value"].startswith("{"), F.coalesce(inner, F.array(e))).otherwise(F.array(e))

    return F.flatten(F.transform(entries, one))


def path_steps(wrapper: str, upper_first: bool, depth: int = MAX_DEPTH) -> tuple[Callable[[Column], Column], ...]:
    """Steps from a JSON column to array<struct<key,value>> of every leaf, key being the path joined with dots.

    An outer level {wrapper: {...}} is left out, and a list of {"tag": ..., "value": ...} is read as an object. With
    upper_first, first keys are in upper case. `depth` levels are unrolled here; what is nested deeper is opened in
    the Arrow stage (open_leaves), so no level is lost. Null if the text is no valid JSON."""

    def unwrap(t: Column) -> Column:
        inner = F.get_json_object(t, f"$.{wrapper}")
        return F.when(t.startswith("{"), F.when(inner.startswith("{"), inner).otherwise(t)).otherwise(t)

    def first(t: Column) -> Column:
        tagged = F.transform(
            F.from_json(t, "array<struct<tag:string,value:string>>", JSON_OPTIONS),
            lambda e: F.struct(e["tag"].alias("key"), e["value"].alias("value")),
        )
        return F.when(t.startswith("{"), _entries(t)).when(t.startswith("["), F.filter(tagged, lambda e: e["key"].isNotNull()))

    def upper(top: Column) -> Column:
        return F.transform(top, lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value")))

    def deeper(top: Column) -> Column:
        return F.when(F.exists(top, lambda e: e["value"].startswith("{")), _deeper(top)).otherwise(top)

    return (*JSON_TEXT, unwrap, first, *([upper] if upper_first else []), *[deeper] * (depth - 1))


def open_leaves(keys: pa.Array, paths: pa.Array, values: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Opens leaves that still hold a JSON object (deeper than the unrolled levels); the rest passes unchanged."""
    deep = pc.fill_null(pc.starts_with(values, "{"), False)
    if not pc.any(deep).as_py():
        return keys, paths, values
    flat = pc.invert(deep)
    out: list[tuple] = []
    for k, p, v in zip(keys.filter(deep).to_pylist(), paths.filter(deep).to_pylist(), values.filter(deep).to_pylist(), strict=True):
        stack = [(p, v)]
        try:
            stack = [(p, json.loads(v))]
        except ValueError:
            pass
        while stack:
            q, w = stack.pop()
            if isinstance(w, dict):
                stack += [(f"{q}.{x}", y) for x, y in w.items()]
            elif w is not None:
                out.append((k, q, w if isinstance(w, str) else json.dumps(w)))
    more = [pa.array([r[i] for r in out], a.type) for i, a in enumerate((keys, paths, values))]
    return tuple(pa.concat_arrays([_chunk(a.filter(flat)), m]) for a, m in zip((keys, paths, values), more, strict=True))


def _chunk(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def children(keys: pa.Array, lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(key of the parent, child) for every element of a list array: parent indices out of the offsets, then take.
    Null and empty lists have no children; null elements are left out."""
    parent, child = pc.list_parent_indices(lists), pc.list_flatten(lists)
    there = pc.is_valid(child)
    return _chunk(keys.take(parent).filter(there)), _chunk(child.filter(there))


FLAT = "parent_kind string, parent_id string, child_kind string, child_id string, value string"


def _rows(parent_kind: str, parents: pa.Array, child_kind: str, ids: pa.Array, values: pa.Array | None = None) -> pa.RecordBatch:
    n = len(ids)
    text = pa.string()
    cols = [pa.repeat(parent_kind, n), parents.cast(text), pa.repeat(child_kind, n), ids.cast(text), pa.nulls(n, text) if values is None else values.cast(text)]
    batch = pa.RecordBatch.from_arrays(cols, names=["parent_kind", "parent_id", "child_kind", "child_id", "value"])
    return batch.filter(pc.and_(pc.is_valid(batch.column(1)), pc.is_valid(batch.column(3))))


def _flatten_customers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = b.column("key")
        owner, address = children(keys, b.column("addresses"))
        ids = address.field("id")
        yield _rows("customer", owner, "address", ids)
        held, contact = children(ids, address.field("contacts"))
        yield _rows("address", held, "contact", contact.field("id"), contact.field("value"))
        owner, address = children(keys, b.column("default_address"))
        yield _rows("customer", owner, "default_address", address.field("id"))


def _flatten_subscribers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = b.column("key")
        for kind, col in (("merge_field", "merge_fields"), ("stat", "stats")):
            owner, entry = children(keys, b.column(col))
            owner, path, value = open_leaves(owner, entry.field("key"), entry.field("value"))
            said = pc.and_(pc.is_valid(value), pc.not_equal(pc.fill_null(value, ""), ""))
            yield _rows("subscriber", owner.filter(said), kind, path.filter(said), value.filter(said))
        owner, interest = children(keys, b.column("interests"))
        yield _rows("subscriber", owner, "interest", interest.field("id"), interest.field("name"))


def _with_ids(addresses: Column) -> Column:
    def one(a: Column) -> Column:
        contacts = F.transform(a["contacts"], lambda x: F.struct(F.nullif(F.trim(x["id"]), F.lit("")).alias("id"), x["value"].alias("value")))
        return F.struct(bare_digits(a["id"]).alias("id"), contacts.alias("contacts"))

    return F.transform(addresses, one)


def flatten_customers(df: DataFrame, key: str = "id", addresses: str = "addresses", default: str = "default_address") -> DataFrame:
    """FLAT rows of a customer table: customer-address, address-contact and customer-default_address links.

    One row per child and record: repeated records give repeated rows (take the distinct ones where needed). Rows
    with a null key, fields that are null, empty or invalid JSON, and children without an id give no row. Other
    columns of df are not read, whatever their names. An empty table gives an empty table."""
    shaped = df.select(F.col(key).cast("string").alias("key"), F.col(addresses).alias("addresses"), F.col(default).alias("default_address"))
    for name in ("addresses", "default_address"):
        shaped = staged(shaped, name, *JSON_TEXT, _addresses, _with_ids)
    return shaped.where("key is not null").mapInArrow(_flatten_customers, FLAT)


def flatten_subscribers(df: DataFrame, key: str = "subscriber_id", merge_fields: str = "merge_fields", stats: str = "stats") -> DataFrame:
    """FLAT rows of a subscriber table: merge_field, stat and interest links, keyed by the lower-case subscriber id.

    Values that are null or an empty string give no row; INTERESTS is listed as interests and not as a merge field.
    Nulls, repeats, invalid JSON and empty tables are treated as by flatten_customers."""
    is_interest = lambda e: (e["key"] == "INTERESTS") | e["key"].startswith("INTERESTS.")
    shaped = df.select(F.lower(F.trim(F.col(key))).alias("key"), F.col(merge_fields).alias("fields"), F.col(stats).alias("stats"))
    shaped = staged(shaped, "fields", *path_steps("merge_fields", upper_first=True))
    shaped = staged(shaped, "stats", *path_steps("stats", upper_first=False))
    listed = F.get(F.filter(F.col("fields"), lambda e: e["key"] == "INTERESTS"), F.lit(0))["value"]
    shaped = shaped.select(
        "key",
        F.filter("fields", lambda e: ~is_interest(e)).alias("merge_fields"),
        "stats",
        F.from_json(listed, "array<struct<id:string,name:string>>", JSON_OPTIONS).alias("interests"),
    )
    return shaped.where("key is not null").mapInArrow(_flatten_subscribers, FLAT)


def flat_schema() -> T.StructType:
    return T._parse_datatype_string(FLAT)
