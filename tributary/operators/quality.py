"""Quality of an entity index and of tables: the report with its thresholds and the status that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least share of entities in several sources, least coverage of a source, in percent.
LEAST_CROSS, LEAST_COVERAGE = 5.0, 95.0


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows) of keys with several rows; null keys are none."""
    known = df.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def report(index: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(metric, value, threshold, status) of an entity index (unified_id, source, source_id) and the sources' records
    (source_id): sizes, the share of entities in several sources, records under several entities, coverage of each
    source; then `overall`, whose value is the exit code: 2 critical with any error, 1 warning with any warning, else
    0 healthy. An empty index gives zeros."""
    records = index.where("source is not null and source_id is not null").groupBy("source", "source_id").agg(F.count_distinct("unified_id").alias("ids"))
    entities = index.where("unified_id is not null").groupBy("unified_id").agg(F.count_distinct("source").alias("sources"))
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("double")
    by_record = records.agg(F.count(F.lit(1)).cast("double").alias("records"), count(F.col("ids") > 1).alias("split_records"))
    by_entity = entities.agg(F.count(F.lit(1)).cast("double").alias("entities"), F.coalesce(F.round(100 * count(F.col("sources") > 1) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0)).alias("cross_source_percent"))
    rows = by_record.unpivot([], by_record.columns, "metric", "value").unionByName(by_entity.unpivot([], by_entity.columns, "metric", "value"))
    for name, frame in sources.items():
        known = records.where(F.col("source") == name).select("source_id").withColumn("_known", F.lit(1))
        here = frame.where("source_id is not null").distinct().join(known, "source_id", "left").agg(F.coalesce(F.round(100 * count(F.col("_known").isNotNull()) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0)).alias("value"))
        rows = rows.unionByName(here.select(F.lit(f"coverage_percent:{name}").alias("metric"), "value"))
    metric, value = F.col("metric"), F.col("value")
    limit = F.when(metric == "cross_source_percent", LEAST_CROSS).when(metric.startswith("coverage_percent"), LEAST_COVERAGE).when(metric == "split_records", 0.0)
    status = F.when((metric == "split_records") & (value > 0), "error").when((metric != "split_records") & (value < limit), "warning").otherwise("info")
    judged = rows.select("metric", "value", limit.alias("threshold"), status.alias("status"))
    worst = judged.agg(F.max(F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)).alias("code"))
    overall = worst.select(F.lit("overall").alias("metric"), F.col("code").cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), F.when(F.col("code") == 2, "critical").when(F.col("code") == 1, "warning").otherwise("healthy").alias("status"))
    return judged.unionByName(overall)


def batch_stats(batch: DataFrame, method: str, run_at: str) -> DataFrame:
    """One row on a batch of index rows (unified_id, match_type, match_confidence); nulls for the means of an empty one."""
    new = F.coalesce(F.sum((F.col("match_type") == "new_entity").cast("bigint")), F.lit(0))
    n = F.count(F.lit(1))
    return batch.agg(F.lit(run_at).cast("timestamp").alias("run_at"), F.lit(method).alias("method"), n.alias("records"), new.alias("new_entities"), (n - new).alias("matched"), F.round(F.avg("match_confidence").cast("double"), 4).alias("mean_confidence"))
