import pytest

from tributary.operators import bloom
from tributary.operators.orphans import orphan_report, reference_states
from tributary.operators.skew import hot_keys, lookup_join


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("cast(id * 7 as string) as ref")
    f = bloom.build(keys, "ref")
    probe = spark.range(50000).selectExpr("cast(id as string) as ref").select("ref", bloom.hash_of("ref").alias("h")).select("ref", f.may_contain(__import__("pyspark").sql.functions.col("h")).alias("m"))
    hits = {r.ref for r in probe.where("m").collect()}
    assert {str(i * 7) for i in range(5000)} & {str(i) for i in range(50000)} <= hits
    assert len(hits) < 5000 * 1.5 + 3000


@pytest.mark.parametrize("bits", [None, 64])
def test_states(spark, bits, monkeypatch):
    if bits:  # a saturated filter lets everything through and changes nothing
        monkeypatch.setattr(bloom, "LEAST_BITS", bits)
        monkeypatch.setattr(bloom, "MOST_BITS", bits)
    parents = spark.createDataFrame([("a", 1), ("b", 2)], "ref string, x int")
    refs = spark.createDataFrame([("a", 9), ("a", 9), ("c", 9), (None, 9)], "ref string, present int")
    assert sorted(map(tuple, reference_states(refs, parents).collect())) == [("a", True, 1), ("c", False, None)]


def test_sections_reject_like_one_filter(spark, monkeypatch):
    """Keys beyond the largest filter are dealt to sections; no key is lost, and most of what is absent is rejected."""
    monkeypatch.setattr(bloom, "LEAST_BITS", 1 << 12)
    keys = spark.range(20_000).selectExpr("cast(id * 3 as string) as ref")
    refs = spark.range(30_000).selectExpr("cast(id as string) as ref").unionByName(spark.createDataFrame([(None,)], "ref string"))
    got = {r.ref: r.maybe for r in bloom.probed(refs, keys, "ref", most=1 << 14, section_refs=4000).collect()}
    assert len(got) == 30_000 and all(got[str(i)] for i in range(0, 30_000, 3))
    assert sum(got.values()) < 10_000 + 20_000 * 0.1
    states = {r.ref: r.present for r in reference_states(refs, keys, most_bits=1 << 14).collect()}
    assert states == {str(i): i % 3 == 0 for i in range(30_000)}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "ref string, x int")
    some = spark.createDataFrame([("a", 1)], "ref string, x int")
    assert [tuple(r) for r in reference_states(some, none).collect()] == [("a", False, None)]
    assert reference_states(none, some).count() == 0
    assert orphan_report(none, "ref").count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_equals_join(spark, how):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("k", 1), ("z", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("h", "H"), ("k", "K"), ("u", "U")], "k string, w string")
    assert hot_keys(left, "k", 4, 10) == ["h"]
    got = lookup_join(left, right, "k", how, 4, 10)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_lookup_join_refuses_other_kinds(spark):
    with pytest.raises(ValueError):
        lookup_join(spark.range(1), spark.range(1), "id", "full")


def test_binary_hot_keys(spark):
    left = spark.range(60).selectExpr("if(id % 2 = 0, cast('hot' as binary), cast(concat('k', id) as binary)) as k", "id")
    right = spark.sql("select cast('hot' as binary) as k, 1 as w union all select cast('k1' as binary), 2")
    got = lookup_join(left, right, "k", "inner", 4, 10)
    assert got.count() == 31
