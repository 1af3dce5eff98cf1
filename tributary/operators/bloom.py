"""A Bloom filter over a key column: built by built-in expressions, broadcast, probed by Arrow batches.

Keys too many for a filter that may be broadcast are dealt to sections by their hash; each section has a filter of its
own, which meets the references of that section and is never broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per key and hash functions: about 1 % false positives.
BITS_PER_KEY, HASHES = 10, 7
#: Bounds of one filter: 8 KiB to 8 MiB, which is enough for 6.7 million keys. More keys are dealt to sections.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: References that are probed together in one section, at most about.
SECTION_REFS = 2_000_000


def hash_of(key: str | Column) -> Column:
    return F.xxhash64(key)


def _position(h: Column, i: int, bits: int) -> Column:
    """Double hashing: the halves of a 64-bit hash give h1 + i * h2, cut to a position below bits (a power of two)."""
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("bigint"))
    return (low + F.lit(i).cast("bigint") * high).bitwiseAND(bits - 1)


@dataclass(frozen=True)
class BloomFilter:
    words: Broadcast  # uint64 array of bits/64 words, MOST_BITS / 8 bytes at most
    bits: int
    hashes: int

    def may_contain(self, h: Column) -> Column:
        """Of a key's hash_of(): false if the key is certainly absent, true if it may be present or h is null."""
        words, bits, hashes = self.words, self.bits, self.hashes

        @F.pandas_udf("boolean")
        def probe(s: pd.Series) -> pd.Series:
            return pd.Series(_probe(words.value, s.to_numpy(dtype="int64", na_value=0), bits, hashes) | s.isna().to_numpy())

        return probe(h)


def _probe(words: np.ndarray, h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    v = h.astype("int64").view("uint64")
    low, high = v & np.uint64(0xFFFFFFFF), (v >> np.uint64(32)) | np.uint64(1)
    hit = np.ones(len(v), bool)
    for i in range(hashes):
        p = (low + np.uint64(i) * high) & np.uint64(bits - 1)
        hit &= (words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def bits_for(n: int, most: int = MOST_BITS) -> int:
    """Bits of a filter for n keys: a power of two between the bounds."""
    bits = LEAST_BITS
    while bits < most and bits < BITS_PER_KEY * n:
        bits *= 2
    return bits


def _words(keys: DataFrame, key: str, bits: int, hashes: int, section: Column) -> DataFrame:
    """(section, word, bit), combined on the map side: what is shuffled is bounded by the size of the filters."""
    marked = keys.where(F.col(key).isNotNull()).select(section.alias("section"), F.explode(F.array(hash_of(key))).alias("h"))
    marked = marked.select("section", F.explode(F.array(*[_position(F.col("h"), i, bits) for i in range(hashes)])).alias("p"))
    marked = marked.select("section", F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    return marked.groupBy("section", "word").agg(F.bit_or("bit").alias("bit"))


def build(keys: DataFrame, key: str, bits: int | None = None, hashes: int = HASHES) -> BloomFilter:
    """The filter of the non-null values of one column; repeats do no harm.

    What is shuffled and what reaches the driver is bounded by the size of the filter (16 bytes a word) and not by the
    number of keys. Of an empty table every word is 0: nothing is contained."""
    if bits is None:
        bits = bits_for(keys.agg(F.approx_count_distinct(key).alias("n")).first()["n"])
    found = _words(keys, key, bits, hashes, F.lit(0)).toArrow()
    words = np.zeros(bits // 64, "uint64")
    words[found["word"].to_numpy()] = found["bit"].to_numpy().view("uint64")
    return BloomFilter(keys.sparkSession.sparkContext.broadcast(words), bits, hashes)


def _section(h: Column, sections: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(sections)).cast("int")


def probed(refs: DataFrame, keys: DataFrame, key: str, most: int = MOST_BITS, section_refs: int = SECTION_REFS, hashes: int = HASHES) -> DataFrame:
    """The distinct non-null references (key, maybe): maybe is false for those that `keys` certainly lacks.

    One filter is broadcast where one of `most` bits is enough for all keys; else keys and references are dealt to
    sections by their hash, and each section's references are probed by its own filter in one task."""
    distinct = refs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(hash_of(key)).alias("h"))
    n = keys.agg(F.approx_count_distinct(key).alias("n")).first()["n"]
    if BITS_PER_KEY * n <= most or bits_for(n, most) < most:
        seen = build(keys, key, bits_for(n, most), hashes)
        return distinct.select(key, seen.may_contain(F.col("h")).alias("maybe"))
    n_refs = refs.agg(F.approx_count_distinct(key).alias("n")).first()["n"]
    sections = max(2, -(-BITS_PER_KEY * n // most), -(-n_refs // section_refs))
    bits = bits_for(-(-n // sections), most)
    words = _words(keys, key, bits, hashes, _section(hash_of(key), sections))
    kind = refs.schema[key].dataType.simpleString()

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(bits // 64, "uint64")
        table[right["word"].to_numpy("int64")] = right["bit"].to_numpy("int64").view("uint64")
        return pd.DataFrame({key: left[key], "maybe": _probe(table, left["h"].to_numpy("int64"), bits, hashes)})

    mine = distinct.withColumn("section", _section(F.col("h"), sections))
    return mine.groupBy("section").cogroup(words.groupBy("section")).applyInPandas(probe, f"`{key}` {kind}, maybe boolean")
