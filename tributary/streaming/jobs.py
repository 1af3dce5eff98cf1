"""Structured Streaming jobs. Each uses the batch transforms, so stream and batch give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.operators.entity import unified_id
from tributary.session import forget, saved
from tributary.sources.lake import LakeTable


def append_raw(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Exactly-once append to Parquet; what is available now is processed, then the query ends."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.partitionBy(partition) if partition else writer).trigger(availableNow=True).start()


def transformed(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """A stateless batch transform over a stream."""
    return append_raw(transform(stream), path, checkpoint)


def session_counts(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Session windows by inactivity gap, closed by the watermark."""
    w = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key)
    return w.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def window_counts(stream: DataFrame, ts: str, size: str, delay: str, by: str) -> DataFrame:
    """Counts by tumbling window."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("window_start"), by, "events")


def replaced(stream: DataFrame, target: LakeTable, checkpoint: str) -> StreamingQuery:
    """An aggregate in complete mode into a table of the store: every micro-batch replaces it in one step."""
    return stream.writeStream.outputMode("complete").foreachBatch(lambda df, _epoch: target.replace(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_files(stream: DataFrame, path: str, checkpoint: str, day: str, rows_a_file: int, every: str | None = None) -> StreamingQuery:
    """JSON lines in folders by day, files of at most rows_a_file rows, and a success file in every folder that a
    micro-batch has written. A batch that is run again overwrites its own files. every: the interval at which files
    are rolled; without one, what is available now is written and the query ends."""

    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.withColumn("dt", F.date_format(day, "yyyy-MM-dd")).withColumn("batch", F.lit(epoch)).persist()
        rows.write.partitionBy("dt", "batch").option("maxRecordsPerFile", rows_a_file).option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for r in rows.select("dt").distinct().collect():
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/dt={r[0]}/_SUCCESS")
            at.getFileSystem(conf).create(at, True).close()
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rates(query: StreamingQuery) -> list[tuple[int, float, float]]:
    """(rows, rows a second in, rows a second processed) of the batches that a query still remembers."""
    return [(p["numInputRows"], p.get("inputRowsPerSecond") or 0.0, p.get("processedRowsPerSecond") or 0.0) for p in query.recentProgress]


def united(*streams: DataFrame) -> DataFrame:
    """Streams with the same columns as one; the watermark is the slowest one's."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def looked_up(stream: DataFrame, table: LakeTable, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of a stream with the columns that a table of the store has for their key when their micro-batch runs; nulls
    where it has none. The table has one row a key. A batch that is run again overwrites its own rows."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.join(table.read(), key, "left").write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LEAST_PHONE = 7


def resolve_stream(stream: DataFrame, index: LakeTable, checkpoint: str, keys: LakeTable | None = None) -> StreamingQuery:
    """Exact entity resolution of a stream (source, source_id, email_token, with keys also phone_token) against the
    persisted index; keys: the table of blocking keys, (blocking_key, blocking_key_type, unified_id).

    In each micro-batch, records are given the id of their token, which is the same whether the match is in the index or
    in the batch itself, and are upserted by (source, source_id); their e-mail and phone keys are added where they are
    new (phones of LEAST_PHONE characters or more). A batch that is run again changes nothing."""

    def batch(df: DataFrame, _epoch: int) -> None:
        rest = [c for c in df.columns if c not in ("source", "source_id")]
        once = df.groupBy("source", "source_id").agg(F.min(F.struct(*rest)).alias("r")).select("source", "source_id", "r.*")
        uid = unified_id(F.col("email_token"), F.col("source"), F.col("source_id"))
        rows = saved(once.withColumn("unified_id", uid), "stream-batch")
        known = index.read().select("unified_id").distinct().withColumn("_known", F.lit(True)) if index.exists() else None
        marked = rows.join(known, "unified_id", "left") if known is not None else rows.withColumn("_known", F.lit(None).cast("boolean"))
        kind = F.when(F.col("_known"), "exact_email").otherwise("new_entity")
        index.merge_upsert(marked.select("unified_id", "source", "source_id", kind.alias("match_type")), ["source", "source_id"])
        if keys is not None:
            email = F.nullif(F.trim("email_token"), F.lit(""))
            made = {"email": email, "phone": F.when(F.length("phone_token") >= LEAST_PHONE, F.col("phone_token"))}
            entries = F.array(*[F.when(c.isNotNull(), F.struct(F.concat(F.lit(f"{k}:"), c).alias("blocking_key"), F.lit(k).alias("blocking_key_type"))) for k, c in made.items()])
            found = rows.select("unified_id", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("k"))
            keys.merge_insert(found.select("k.blocking_key", "k.blocking_key_type", "unified_id").distinct(), ["blocking_key", "unified_id"])
        forget(rows)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
