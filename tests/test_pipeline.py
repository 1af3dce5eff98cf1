"""Jobs around the operators: dispatch, lineage, sinks, quality, generators, staging on streams."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF
from tributary.operators import entity, quality
from tributary.operators.incremental import TableSpec, run, run_all, sql_lineage, sql_order
from tributary.sources import scans
from tributary.sources.lake import LakeTable
from tributary.streaming import jobs


def test_modes(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/t", "m")
    rows = {"all": [("a", 1), ("b", 2)], "touched": [("b", 5)]}
    read = lambda scope: spark.createDataFrame(rows[scope], "m string, v int")
    spec = TableSpec("t", lambda df: df, "touched", "overwrite")
    assert run(spec, t, read, "incremental", dry_run=True).count() == 2 and not t.exists()
    run(spec, t, read, "incremental")  # the first run is a full one
    run(spec, t, read, "incremental")
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 5)]
    run(spec, t, read, "full")
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        run(spec, t, read, "sometimes")


def test_failures_stay_with_their_own():
    made = lambda n, *on: TableSpec(n, None, "all", "replace", depends_on=on)
    specs = [made("a"), made("b", "a"), made("c"), made("d", "b", "c")]
    assert run_all(specs, lambda s: 1 / (s.name != "a")) == {"a": "failed", "c": "done", "b": "skipped", "d": "skipped"}
    assert run_all(specs, lambda s: None, only=["d"]) == {"d": "done"}


def test_rebuild(spark, tmp_path):
    from tributary.operators.incremental import rebuild

    tables = {n: LakeTable(spark, f"file://{tmp_path}/{n}") for n in "ab"}
    specs = [TableSpec("b", lambda df: df, "all", "replace", depends_on=("a",)), TableSpec("a", lambda df: df, "all", "replace")]
    one = lambda s: run(s, tables[s.name], lambda scope: spark.range(2) if s.name == "a" else tables["a"].read(), "full")
    assert run_all(specs, one) == {"a": "done", "b": "done"} and run_all(specs, one)["b"] == "done"
    assert len(tables["b"].versions()) == 2
    assert rebuild(specs, tables, one) == {"a": "done", "b": "done"}
    assert len(tables["b"].versions()) == 1 and tables["b"].read().count() == 2


def test_lineage_of_sql():
    sql = {
        "one": "INSERT INTO core.c WITH x AS (SELECT * FROM stg.a) SELECT * FROM x JOIN stg.b ON x.i = b.i -- FROM no.table",
        "two": "CREATE TABLE stg.a AS SELECT 'FROM no.other' AS v FROM raw.a",
        "stg.b": "SELECT * FROM (SELECT * FROM raw.b)",
    }
    assert sql_lineage(sql) == {"core.c": {"stg.a", "stg.b"}, "stg.a": {"raw.a"}, "stg.b": {"raw.b"}}
    order = sql_order(sql)
    assert set(order) == {"core.c", "stg.a", "stg.b"} and order[-1] == "core.c"


def test_rolled_files(spark, tmp_path):
    raw, out, check = f"{tmp_path}/raw", f"{tmp_path}/out", f"{tmp_path}/check"
    spark.range(50).selectExpr("cast(id as string) as payload").coalesce(1).write.text(raw)
    stream = lambda: scans.text_stream(spark, raw).withColumn("ts", F.timestamp_seconds(F.col("payload").cast("bigint") % 2 * 86400))
    for _ in range(2):
        q = jobs.rolling_files(stream(), out, check, "ts", 10)
        q.awaitTermination()
        assert all(r[0] >= 0 for r in jobs.rates(q))
    for day in ("1970-01-01", "1970-01-02"):
        files = [f for _, _, fs in os.walk(f"{out}/dt={day}") for f in fs if f.endswith(".json")]
        assert os.path.exists(f"{out}/dt={day}/_SUCCESS") and len(files) == 3
    assert spark.read.schema("payload string").json(out).count() == 50


def test_report(spark):
    index = [("u1", "s", "1"), ("u1", "m", "2"), ("u2", "s", "3"), ("u3", "s", "3"), (None, "s", None)]
    df = spark.createDataFrame(index, "unified_id string, source string, source_id string")
    records = spark.createDataFrame([("1",), ("3",), ("4",), ("4",), (None,)], "source_id string")
    got = {r.metric: (r.value, r.status) for r in quality.report(df, {"s": records}).collect()}
    assert got == {"records": (3.0, "info"), "split_records": (1.0, "error"), "entities": (3.0, "info"), "cross_source_percent": (33.3333, "info"), "coverage_percent:s": (66.6667, "warning"), "overall": (2.0, "critical")}
    empty = {r.metric: r.value for r in quality.report(df.limit(0), {"s": records.limit(0)}).collect()}
    assert empty["records"] == 0 and empty["overall"] == 1
    assert [tuple(r) for r in quality.duplicates(df, ["source", "source_id"]).collect()] == [("s", "3", 2)]
    stats = quality.batch_stats(spark.createDataFrame([], "match_type string, match_confidence double"), "fuzzy", "2024-01-01").first()
    assert (stats.records, stats.matched, stats.mean_confidence) == (0, 0, None)


def test_generators_are_the_same_for_a_seed(spark):
    for source in scans.GENERATED:
        a = scans.generate_people(spark, source, 50, 20)
        assert sorted(map(str, a.collect())) == sorted(map(str, scans.generate_people(spark.newSession(), source, 50, 20).repartition(7).collect()))
        assert a.select("person").distinct().count() <= 20
    assert scans.generate_people(spark, "shop", 50, 20, seed=1).exceptAll(scans.generate_people(spark, "shop", 50, 20)).count() > 0


def test_tables_and_views(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/threes.parquet")
    assert scans.register_views(spark, f"{tmp_path}", "v_") == ["threes"] and spark.table("v_threes").count() == 3
    assert scans.listed_tables(spark, ["no_such_namespace"]) == []
    assert scans.table_or(spark, "no_such_table", spark.range(1)).count() == 1
    with pytest.raises(ValueError):
        scans.write_files(spark.range(1), f"{tmp_path}/x", "stone")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_by_sound_finds_what_zip_misses(spark):
    from tributary.plans import entities

    rows = entities.entity_pipeline(spark, SF).collect()
    new = {(r.source, r.source_id) for r in entities.entity_unresolved(spark, SF).collect()}
    assert {(r.source, r.source_id) for r in rows} == new and len(rows) == len(new)


def test_unmatched_records_become_entities(spark):
    p = spark.createDataFrame([("s", "1"), ("s", "2")], "source string, source_id string")
    rows = entity.new_entities(p, p.where("source_id = '1'")).collect()
    assert [(r.source_id, r.match_type) for r in rows] == [("2", "new_entity")] and rows[0].unified_id.startswith("U-")


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from tributary import session

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(type("S", (), {"sparkContext": Context}))
    saved = session.saved(spark.range(3), "x")
    assert saved.count() == 3
    session.forget(saved, spark.range(1))
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        spark.read.schema("id bigint").parquet(saved.inputFiles()[0]).count()


def test_late_data_is_the_latest_load(spark):
    from tributary.operators.windows import latest_per_key

    day = datetime.datetime(2024, 1, 1)
    batches = [[("k", day, 1), ("j", day, 1)], [("k", day - datetime.timedelta(1), 2)]]
    frames = [spark.createDataFrame(b, "k string, at timestamp, load int") for b in batches]
    got = latest_per_key(frames[0].unionByName(frames[1]), ["k"], ["load", "at"]).collect()
    assert sorted((r.k, r.load) for r in got) == [("j", 1), ("k", 2)]
