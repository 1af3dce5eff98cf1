"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least 1/HOT_SHARE of the rows, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 500
#: Fewer rows of one key are no burden for a task.
LEAST = 20_000
#: Tasks over which a hot key of both sides is spread.
SALTS = 16


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE, least: int = LEAST) -> list:
    """The keys that hold at least 1/share of df's non-null rows (and `least` rows at all).

    At most `share` values reach the driver whatever the size of df. The counts are combined on the map side,
    so a hot key costs one row per task."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    totals = counts.agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
    if not totals["n"] or totals["m"] < least:
        return []
    floor = max(least, -(-totals["n"] // share))
    return [r[0] for r in counts.where(F.col("count") >= floor).limit(share).collect()]


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    share: int = HOT_SHARE,
    least: int = LEAST,
) -> DataFrame:
    """left joined with right on one column, `right` having at most one row a key.

    Rows of hot keys meet a broadcast of at most `share` rows of right and are never shuffled; the rest joins by
    shuffle, so no task gets more than about 1/share of left for a single key. Null keys match nothing (they stay
    with how="left" and leave with how="inner"). Empty inputs give the plain join's result.
    """
    if how not in ("left", "inner", "left_anti", "left_semi"):
        raise ValueError(f"lookup_join does not support how={how!r}")
    hot = hot_keys(left, key, share, least)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.where(~is_hot | F.col(key).isNull()).join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, salts: int = SALTS, share: int = HOT_SHARE, least: int = LEAST) -> DataFrame:
    """left joined with right on one column, both with any number of rows a key; null keys match nothing.

    Rows of left with hot keys are spread over `salts` groups by the column spread_by, and right's rows of such keys
    are repeated for each, so no task gets all of a hot key's pairs."""
    hot = hot_keys(left, key, share, least)
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    spread = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0).cast("bigint")))
    repeated = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))))
    return spread.join(repeated, [key, "_salt"]).drop("_salt")
