import pytest

from tributary.operators.incremental import TableSpec, Watermarks, recompute_touched, run_order, since
from tributary.sources.lake import CardinalityViolation, CommitConflict, LakeTable


def rows(t, v=None):
    return sorted(map(tuple, t.read(v).collect()))


def test_life_of_a_table(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        t.read()
    f = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    t.replace(f((1, "a"), (2, "b")))
    t.merge_upsert(f((2, "B"), (3, "C")), ["k"])
    t.merge_insert(f((3, "no"), (4, "d"), (4, "d")), ["k"])
    assert rows(t) == [(1, "a"), (2, "B"), (3, "C"), (4, "d")]
    assert rows(t, 1) == [(1, "a"), (2, "b")]
    with pytest.raises(CardinalityViolation):
        t.merge_upsert(f((1, "x"), (1, "y")), ["k"])
    assert [s.rows for s in t.snapshots()] == [2, 3, 4]
    for i in range(5):
        t.append(f((10 + i, "x")))
    assert t.compact(dry_run=True) > 0
    assert t.file_rows().agg({"rows": "sum"}).first()[0] == 9 and t.file_rows().count() <= len(t.files())
    assert t.compact() > 0 and len(t.files()) == 1 and len(rows(t)) == 9
    t.rollback(1)
    assert rows(t) == [(1, "a"), (2, "b")]
    t.truncate()
    assert rows(t) == []
    assert t.expire(float("inf"), retain_last=3, dry_run=True) == t.expire(float("inf"), retain_last=3)
    assert len(t.versions()) == 3
    assert t.remove_orphans(float("inf"))
    assert rows(t) == []


def test_merge_rewrites_only_files_with_a_key(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/part ed", "m")
    f = lambda *x: spark.createDataFrame(list(x), "m string, k int, v string")
    t.replace(f(("a b/1", 1, "x"), ("c", 2, "x")).coalesce(1))
    t.append(f(("c", 3, "x"), ("d", 4, "x")).coalesce(1))
    snap = t.merge_upsert(f(("c", 3, "y"), ("e", 5, "y"), ("d", 1, "moved")), ["k"])
    assert snap.rewritten == 2 and snap.rows == 5 == t.read().count()
    assert sorted(map(tuple, t.read().select("k", "m", "v").collect())) == [(1, "d", "moved"), (2, "c", "x"), (3, "c", "y"), (4, "d", "x"), (5, "e", "y")]
    assert t.merge_upsert(f(("z", 9, "new")), ["k"]).rewritten == 0
    assert t.merge_upsert(f(("z", 9, "again")), ["k"]).rewritten == 1 and t.read().count() == 6
    assert [tuple(r) for r in t.read(partitions=["z"]).collect()] == [("z", 9, "again")]


def test_two_inserters_conflict(spark, tmp_path, monkeypatch):
    t, other = LakeTable(spark, f"file://{tmp_path}/i"), LakeTable(spark, f"file://{tmp_path}/i")
    f = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    t.replace(f((1, "a")))
    append = t.append
    monkeypatch.setattr(t, "append", lambda df, base=None: (other.merge_insert(f((2, "b")), ["k"]), append(df, base))[1])
    with pytest.raises(CommitConflict):
        t.merge_insert(f((2, "c"), (2, "a")), ["k"])
    assert rows(other) == [(1, "a"), (2, "b")]
    other.merge_insert(f((3, "z"), (3, "y")), ["k"])
    assert rows(other)[-1] == (3, "y")


def test_partitions_and_conflict(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/p", "m")
    f = lambda *x: spark.createDataFrame(list(x), "m string, v int")
    t.replace(f(("a/1", 1), ("b", 2), (None, 3)))
    t.overwrite_partitions(f(("b", 20), ("c", 4)))
    assert sorted(map(str, rows_of(t))) == sorted(map(str, [("a/1", 1), ("b", 20), (None, 3), ("c", 4)]))
    assert t.snapshot().rows == 4
    assert [tuple(r) for r in t.read(partitions=["a/1"]).collect()] == [("a/1", 1)]
    snap = t.snapshot()
    with pytest.raises(CommitConflict):
        t._commit(snap.folders, snap.schema, 1, "late", snap.version - 1)


def rows_of(t):
    return [tuple(r) for r in t.read().collect()]


def test_specs():
    build = lambda df: df
    a = TableSpec("a", build, "all", "replace")
    b = TableSpec("b", build, "new", "insert", ("k",), ("a",))
    assert run_order([b, a]) == ["a", "b"]
    for bad in (("all", "append", ()), ("new", "replace", ()), ("touched", "append", ()), ("all", "merge", ())):
        with pytest.raises(ValueError):
            TableSpec("x", build, *bad)


def test_watermarks_and_touched(spark, tmp_path):
    import datetime

    w = Watermarks(spark, f"file://{tmp_path}/w")
    t = datetime.datetime(2024, 1, 1)
    assert w.get("x", "y") is None
    w.set("x", "y", t, t)
    w.set("x", "y", t + datetime.timedelta(1), t)
    assert w.get("x", "y") == t + datetime.timedelta(1)
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "m string, v int")
    assert since(df, "v", 1).count() == 2 and since(df, "v", None).count() == 3
    assert recompute_touched(df, df.where("v = 2"), "m", lambda x: x).count() == 2
