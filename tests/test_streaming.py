import json

from tributary.sources.lake import LakeTable
from tributary.sources.scans import enveloped, json_event_stream, json_events, or_typed_nulls, routed
from tributary.streaming import jobs
from pyspark.sql import functions as F

SCHEMA = "source string, source_id string, email_token string, ts timestamp"


def land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_resolver_is_idempotent(spark, tmp_path):
    index = LakeTable(spark, f"file://{tmp_path}/index")
    src = tmp_path / "in"
    land(src, "a", [{"source": "s", "source_id": "1", "email_token": "t"}, {"source": "g", "source_id": "2", "email_token": "t"}])
    run = lambda: jobs.resolve_stream(spark.readStream.schema(SCHEMA).json(str(src)), index, f"{tmp_path}/check").awaitTermination()
    run()
    run()
    land(src, "b", [{"source": "h", "source_id": "3", "email_token": "t"}, {"source": "h", "source_id": "4", "email_token": None}])
    run()
    rows = {r.source_id: r for r in index.read().collect()}
    assert len(rows) == 4 and len({rows[k].unified_id for k in "123"}) == 1
    assert rows["3"].match_type == "exact_email" and rows["4"].match_type == "new_entity"


def test_sessions_and_raw(spark, tmp_path):
    src = tmp_path / "ev"
    land(src, "a", [{"source": "u", "source_id": str(i), "ts": t} for i, t in enumerate(["2024-01-01T00:00:00Z", "2024-01-01T00:20:00Z", "2024-01-01T02:00:00Z", "2024-01-03T00:00:00Z"])])
    stream = json_event_stream(spark, str(src), SCHEMA, "ts")
    counts = jobs.session_counts(spark.readStream.schema(SCHEMA).json(str(src)), "source", "ts", "30 minutes", "5 minutes")
    jobs.append_raw(counts, f"{tmp_path}/sessions", f"{tmp_path}/c1").awaitTermination()
    assert sorted(r.events for r in spark.read.parquet(f"{tmp_path}/sessions").collect()) == [1, 2]
    jobs.transformed(stream, lambda d: d.select("source_id"), f"{tmp_path}/raw", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 4


def test_scans(spark, tmp_path):
    land(tmp_path / "j", "a", [{"source": "s"}])
    (tmp_path / "j" / "b.json").write_text('{"source": "x", broken\n{"source": "t", "source_id": "1"}')
    df = json_events(spark, str(tmp_path / "j"), "source string, source_id string")
    assert sorted((r.source, r.source_id) for r in df.collect()) == [("s", None), ("t", "1")]
    assert [r[0] for r in df.select(routed(F.col("source"), {"s": "topic"})).collect()].count("topic") == 1
    assert [r[0] for r in df.select(routed(F.col("source"), {"s": "topic"}, None)).collect()].count(None) == 1
    assert or_typed_nulls(None, "source", df, {"n": "int"}).schema["n"].dataType.simpleString() == "int"
    assert or_typed_nulls(df.selectExpr("source", "1 as n"), "source", df, {"n": "int"}).where("n = 1").count() == 2
    assert enveloped(df, "shop", F.lit("e"), "2024-01-01").columns[-3:] == ["_webhook_received_at", "_source", "_event_type"]
