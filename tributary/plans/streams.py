"""Streaming and incremental jobs over landed events and people, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.exprs import money
from tributary.operators.incremental import TableSpec, run
from tributary.plans.entities import people
from tributary.plans.entities_sql import PEOPLE
from tributary.plans.tables import _event_files, _orders
from tributary.session import scratch, table
from tributary.sources import scans
from tributary.sources.lake import LakeTable
from tributary.streaming import jobs


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a gap of half an hour, from a stream with a watermark."""
    at, schema = _event_files(spark, sf_dir)
    stream = spark.readStream.schema(schema).json(at).withColumn("ts", F.to_timestamp("ts"))
    t = LakeTable(spark, scratch(spark, "stream-sessions"))
    jobs.replaced(jobs.session_counts(stream, "user_id", "ts", "30 minutes", "1 hour"), t, scratch(spark, "check")).awaitTermination()
    return t.read().select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "events")


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[LakeTable, LakeTable]:
    """Two landed sources, united as streams and resolved, twice: the second run finds nothing new."""
    p = people(spark, sf_dir).select("source", "source_id", "email_token", "phone_token")
    paths = {n: scratch(spark, f"people-{n}") for n in ("customer", "supplier")}
    for n, at in paths.items():
        p.where(F.col("source") == n).write.parquet(at)
    index, keys, check = LakeTable(spark, scratch(spark, "stream-index")), LakeTable(spark, scratch(spark, "stream-keys")), scratch(spark, "check")
    for _ in range(2):
        stream = jobs.united(*[spark.readStream.schema(p.schema).parquet(at) for at in paths.values()])
        jobs.resolve_stream(stream, index, check, keys).awaitTermination()
    return index, keys


def stream_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[0].read().select("unified_id", "source", "source_id")


def stream_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[1].read()


def stream_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads rolled into files by day: rows of each day."""
    at, _ = _event_files(spark, sf_dir)
    out = scratch(spark, "rolled")
    stream = scans.text_stream(spark, at).withColumn("ts", F.to_timestamp(F.get_json_object("payload", "$.ts")))
    jobs.rolling_files(stream.select("payload", "ts"), out, scratch(spark, "check"), "ts", 1000).awaitTermination()
    rows = spark.read.schema("payload string, ts string, dt string, batch long").json(out)
    return rows.groupBy(F.col("dt").cast("date").alias("event_date")).agg(F.count("payload").alias("rows"))


def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream with their user's segment, looked up in a table of the store as each micro-batch runs."""
    at, schema = _event_files(spark, sf_dir)
    out, users = scratch(spark, "looked-up"), LakeTable(spark, scratch(spark, "users"))
    users.replace(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"))
    jobs.looked_up(spark.readStream.schema(schema).json(at), users, "user_id", out, scratch(spark, "check")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "c_mktsegment")


def dispatch_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue: a full run over two thirds of the orders, an incremental one over the months the rest touches,
    and a dry run that writes nothing."""
    o = _orders(spark, sf_dir).withColumn("month_key", F.date_format("order_date", "yyyy-MM"))
    build = lambda df: df.groupBy("month_key").agg(F.count(F.lit(1)).alias("orders"), money(F.sum(money("o_totalprice"))).alias("revenue"))
    spec, t = TableSpec("monthly", build, "touched", "overwrite"), LakeTable(spark, scratch(spark, "dispatch"), "month_key")
    late = o.where("o_orderkey % 3 = 0")
    run(spec, t, lambda scope: o.where("o_orderkey % 3 <> 0"), "incremental")
    run(spec, t, lambda scope: o.join(late.select("month_key").distinct(), "month_key", "left_semi") if scope == "touched" else o, "incremental")
    run(spec, t, lambda scope: o.limit(0), "full", dry_run=True)
    return t.read().withColumn("versions", F.lit(len(t.versions())))


NAMES = ["stream_sessions", "stream_resolved", "stream_keys", "stream_rolling", "stream_lookup", "dispatch_modes"]
QUERIES = {n: globals()[n] for n in NAMES}

_UID = "'U-' || substr(sha256(CASE WHEN trim(email_token) = '' THEN source || '|' || source_id ELSE trim(email_token) END), 1, 32)"
ORACLE = {
    "stream_sessions": """SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS events FROM (
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "stream_resolved": f"SELECT {_UID} AS unified_id, source, source_id FROM ({PEOPLE})",
    "stream_keys": f"SELECT DISTINCT 'email:' || trim(email_token) AS blocking_key, 'email' AS blocking_key_type, {_UID} AS unified_id FROM ({PEOPLE}) WHERE trim(email_token) <> '' UNION SELECT 'phone:' || phone_token, 'phone', {_UID} FROM ({PEOPLE}) WHERE length(phone_token) >= 7",
    "stream_rolling": "SELECT CAST(ts AS DATE) AS event_date, count(*) AS rows FROM events GROUP BY 1",
    "stream_lookup": "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id",
    "dispatch_modes": "SELECT strftime(o_orderdate, '%Y-%m') AS month_key, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS revenue, 2 AS versions FROM orders GROUP BY 1",
}
