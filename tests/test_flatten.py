import json

from tributary.operators.flatten import flatten_customers, flatten_subscribers

C = "id bigint, addresses string, default_address string, parent_id string, child_id int"
S = "subscriber_id string, merge_fields string, stats string, key string"


def rows(df):
    return sorted({tuple(r)[:4] for r in df.collect()})


def test_shapes_of_addresses(spark):
    a = {"id": 11, "city": "x", "contacts": [{"id": 5}, None, {"id": "6"}, {"type": "no id"}]}
    shapes = [[a], [[a]], a, {"addresses": [a]}, {"edges": [{"node": a}]}, {"11": a}, json.dumps([a]), [None, {**a, "id": "gid://shop/MailingAddress/11"}], [{**a, "id": "11"}]]
    for shape in shapes:
        got = rows(flatten_customers(spark.createDataFrame([(1, json.dumps(shape), None, "p", 7)], C)))
        assert got == [("address", "11", "contact", "5"), ("address", "11", "contact", "6"), ("customer", "1", "address", "11")], shape


def test_default_address_and_broken(spark):
    full = '{"id": 3}'
    data = [(1, None, full, "", 0), (1, "", "3", "", 0), (2, "[", '{"id": 8', "", 0), (None, "[]", full, "", 0), (3, "null", "null", "", 0), (4, "[]", "{}", "", 0), (5, '[{"id": 1}] tail', None, "", 0)]
    assert rows(flatten_customers(spark.createDataFrame(data, C))) == [("customer", "1", "default_address", "3")]


def test_empty(spark):
    assert flatten_customers(spark.createDataFrame([], C)).count() == 0
    assert flatten_subscribers(spark.createDataFrame([], S)).count() == 0


def test_paths(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": 1, "g": None, "h": ""}}}}}, "z": 0, "k": "{no json"}
    fields = {"fname": "A", "LNAME": "", "PHONE": None, "ADDRESS": {"addr1": "s", "zip": ""}, "INTERESTS": [{"id": "i1", "name": "n"}]}
    got = rows(flatten_subscribers(spark.createDataFrame([(" AbC ", json.dumps({"merge_fields": fields}), json.dumps({"stats": deep}), "x")], S)))
    want = [("interest", "i1"), ("merge_field", "ADDRESS.addr1"), ("merge_field", "FNAME"), ("stat", "a.b.c.d.e.f"), ("stat", "k"), ("stat", "z")]
    assert got == sorted(("subscriber", "abc", k, p) for k, p in want)


def test_tagged_list_and_long(spark):
    tags = [{"tag": "FNAME", "value": "x" * 300_000}, {"tag": "ADDRESS", "value": {"city": "c"}}, {"tag": "LNAME", "value": ""}]
    got = rows(flatten_subscribers(spark.createDataFrame([("s", json.dumps(tags), "not json", "x")] * 2, S)))
    assert got == [("subscriber", "s", "merge_field", "ADDRESS.city"), ("subscriber", "s", "merge_field", "FNAME")]
