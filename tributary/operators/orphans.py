"""References to records that do not exist.

A Bloom filter of the parents' keys proves most orphans at once; only references it lets through are verified by an
exact join. Both steps work on distinct references, so a parent that a third of all rows name costs one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import bloom


def reference_states(refs: DataFrame, parents: DataFrame, key: str = "ref", most_bits: int = bloom.MOST_BITS) -> DataFrame:
    """The distinct non-null values of `key` in refs, with the columns of parents (one row a key) and `present`.

    Keys the filter rejects are orphans without any join; the others are joined exactly. Other columns of refs are
    not read. Parents too many for a filter of most_bits are dealt to sections (bloom.probed). An empty parent table makes every reference an orphan; an empty refs gives an empty result."""
    rest = [c for c in parents.columns if c != key]
    probed = bloom.probed(refs, parents, key, most_bits)
    nothing = [F.lit(None).cast(parents.schema[c].dataType).alias(c) for c in rest]
    definite = probed.where(~F.col("maybe")).select(key, F.lit(False).alias("present"), *nothing)
    checked = probed.where("maybe").select(key).join(parents.withColumn("present", F.lit(True)), key, "left")
    return definite.unionByName(checked.select(key, F.coalesce("present", F.lit(False)).alias("present"), *rest))


def orphan_report(orphans: DataFrame, *by: str) -> DataFrame:
    """Number of orphans by the given columns (field, kind and period of the finding query)."""
    return orphans.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("orphans"))
