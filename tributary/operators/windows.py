"""Ranking, sessions, funnels and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the one with the largest `order` columns (nulls lose), other columns breaking ties.

    An aggregation and no window: copies are combined on the map side, so a key with any share of the rows costs one
    row a task. Nulls are key values like any other; rows equal in every column are one; empty gives empty."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns])


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group under `order`, numbered; end `order` with a unique column for one result.
    The planner limits each group before the shuffle, so a hot group brings n rows a task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def rolling_mean(df: DataFrame, value: str, order: str, rows: int, name: str, partition: list[str] | None = None) -> DataFrame:
    """Mean of the last `rows` rows; meant for aggregates (a row a day), as without a partition one task holds all."""
    w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.avg(value).over(w))


def with_sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, tie: str) -> DataFrame:
    """df with sess_num: a session ends where more than gap_seconds (whole seconds) pass without an event.

    Events with a null time or key belong to no session and are left out. `tie` orders events of one time."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    gap = seconds - F.lag(seconds).over(w)
    started = df.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withColumn("_new", F.when(gap.isNull() | (gap > gap_seconds), 1).otherwise(0))
    return started.withColumn("sess_num", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, tie: str, first: list[str], last: list[str], measures: dict[str, Column]) -> DataFrame:
    """One row a session: its bounds, the attributes of its first and last event, and measures.

    One aggregation after one sort: first and last attributes come by min_by and max_by instead of joins."""
    at = F.struct(ts, tie)
    return with_sessions(df, key, ts, gap_seconds, tie).groupBy(key, "sess_num").agg(
        F.min(ts).alias("session_start"),
        F.max(ts).alias("session_end"),
        *[F.min_by(c, at).alias(f"first_{c}") for c in first],
        *[F.max_by(c, at).alias(f"last_{c}") for c in last],
        *[e.alias(n) for n, e in measures.items()],
    )


def funnel(df: DataFrame, unit: list[str], day: str, event: str, steps: list[str]) -> DataFrame:
    """(day, step_number, step_name, step_users, dropoff, dropoff_rate): units that had each step's event, by day.

    Two aggregations over one scan; the steps are unpivoted from one row a day."""
    flags = df.where(F.col(event).isin(*steps)).groupBy(*unit, day).agg(*[F.max((F.col(event) == s).cast("int")).alias(f"s{i}") for i, s in enumerate(steps)])
    daily = flags.groupBy(day).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(steps))])
    n = len(steps)
    rows = [
        F.struct(
            F.lit(i + 1).alias("step_number"),
            F.lit(s).alias("step_name"),
            F.col(f"s{i}").alias("step_users"),
            (F.col(f"s{i}") - F.col(f"s{i + 1}") if i + 1 < n else F.lit(0).cast("bigint")).alias("dropoff"),
        )
        for i, s in enumerate(steps)
    ]
    out = daily.select(day, F.inline(F.array(*rows)))
    return out.withColumn("dropoff_rate", F.coalesce(F.round(F.try_divide(F.col("dropoff").cast("double"), F.nullif(F.col("step_users").cast("double"), F.lit(0.0))), 4), F.lit(0.0)))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, take: list[str], tie: str) -> DataFrame:
    """left with `take` of right's latest row of the same key at or before left_ts (null without one).

    Both sides are interleaved in one sort by key and time, and the last right row is carried forward: one shuffle,
    no range join, and no blow-up for keys with many versions. left keeps all its rows, repeats too; of right rows with
    one time the larger `tie` wins. A null key or time matches nothing."""
    cols = [F.col(c).alias(f"_l_{c}") for c in left.columns]
    payload = F.struct(*[F.col(c).alias(c) for c in take])
    empty = F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    r = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("string").alias("_tie"), payload.alias("_p"),
        *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in left.columns],
    )
    both = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_tie"), empty.alias("_p"), *cols).unionByName(r)
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.col("_p")), ignorenulls=True).over(w)
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    out = both.withColumn("_found", F.when(known, found)).where("_side = 1")
    return out.select(*[F.col(f"_l_{c}").alias(c) for c in left.columns], *[F.col(f"_found.`{c}`").alias(f"asof_{c}") for c in take])
