"""Exactly one copy of every message that was delivered at least once.

MessageStore keeps the winners in partitions by period of first arrival and bucket of the identifier, with an index
from message identifiers to partitions. A batch is taken in by looking up, in the index buckets of its own identifiers,
which historical partitions hold any of its messages; only those are read, combined with the batch, reduced to single
winners, and overwritten in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import forget, saved
from tributary.sources.lake import LakeTable

COPIES, PLACE = "_copies", "_place"
#: Buckets of identifiers in a period: more for more rows a period.
BUCKETS = 4


class MessageStore:
    """Deduplicated messages under one path, in a table of the store and an index beside it.

    keys: the columns that identify a message (nulls are values like any other). order: the columns by which the
    winner among copies is chosen, largest first (nulls lose); equal copies are interchangeable, and of copies that
    tie in `order` but differ elsewhere the one with the largest remaining columns wins, so results do not depend on
    row order. period: a SQL expression over the columns giving the period of a new message, which stays the
    message's for good. Of two writers at a time, one fails with a CommitConflict.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], period: str, buckets: int = BUCKETS):
        self.spark, self.keys, self.order, self.period, self.buckets = spark, keys, order, period, buckets
        self.data = LakeTable(spark, f"{path.rstrip('/')}/messages", PLACE)
        self.index = LakeTable(spark, f"{path.rstrip('/')}/index", "_bucket")

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def _bucket(self) -> Column:
        return F.pmod(self._hash(), F.lit(self.buckets)).cast("string")

    def read(self, periods: list[str] | None = None) -> DataFrame | None:
        """The winners with COPIES, the number of deliveries, and PLACE; None before the first batch. periods: only these."""
        snap = self.data.snapshot()
        if snap is None:
            return None
        return self.data.read(snap.version, None if periods is None else [p for p in snap.folders if p.rsplit("/", 1)[0] in periods])

    def _winners(self, rows: DataFrame) -> DataFrame:
        """One row a message by aggregation (combined on the map side, so a message with any number of copies is
        one row per task before the shuffle)."""
        rest = [c for c in rows.columns if c not in (*self.keys, COPIES, PLACE)]
        best = F.max(F.struct(*self.order, *[c for c in rest if c not in self.order])).alias("_best")
        out = rows.groupBy(*self.keys).agg(best, F.sum(COPIES).alias(COPIES), F.min(PLACE).alias(PLACE))
        return out.select(*self.keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest], COPIES, PLACE)

    def ingest(self, batch: DataFrame) -> list[str]:
        """Takes a batch in and returns the historical partitions that were overwritten.

        Afterwards the store holds one row for each message of the old rows and the batch. An empty batch changes
        nothing. The names of partitions are all that reaches the driver. The index is written first: an entry whose
        message did not follow costs a needless read and nothing else."""
        place = F.concat_ws("/", F.coalesce(F.expr(self.period).cast("string"), F.lit("none")), self._bucket())
        fresh = batch.withColumn(COPIES, F.lit(1).cast("bigint")).withColumn(PLACE, place)
        base = self.data.versions()[-1] if self.data.exists() else 0
        winners = self._winners(fresh)
        entries = lambda rows: rows.select(self._hash().alias("_h"), self._bucket().alias("_bucket"), PLACE)
        add = lambda rows: self.index.append(rows.repartition("_bucket"))
        if not base:
            if not batch.isEmpty():
                self.data.swap_partitions(winners.repartition(PLACE), [], 0, before=lambda rows: add(entries(rows)))
            return []
        rows = saved(winners, "messages-batch")
        where = entries(rows)
        mine = [r[0] for r in where.select("_bucket").distinct().collect()]
        known = saved(self.index.read(partitions=mine).join(where.select("_h").distinct(), "_h", "left_semi"), "messages-known")
        touched = sorted(r[0] for r in known.select(PLACE).distinct().collect())
        add(where.join(known.select("_h"), "_h", "left_anti"))
        whole = self._winners(self.data.read(base, touched).unionByName(rows)) if touched else rows
        self.data.swap_partitions(whole.repartition(PLACE), touched, base)
        forget(rows, known)
        return touched
