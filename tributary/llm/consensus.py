"""The best representative of each duplicate group, field by field.

consensus_rows() is token-level consensus: the usable values of a field in a group are cut into tokens and aligned
progressively, the heaviest first; each column of the alignment is voted on with the values' weights, and the existing
value closest to the voted sequence is emitted. Values weigh what supports them, so several agreeing rows or tokens
outvote a lone one. survivors() is for data whose present value is the latest: nothing older can change it, so there
is no vote and the latest value is taken as it is.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.session import saved

#: Values that are aligned together; more of one group and field are dealt to blocks, whose winners meet again.
BLOCK_VALUES = 64
#: Units of a weight, which is a whole number so that sums don't depend on the order of rows.
UNIT = 1_000_000
GAP = ""
#: Words that stand for no value; a token of one of them stands for no value either.
EMPTY_WORDS = ("", " ", "null", "NULL", "None", "none", "nan", "NaN", "n/a", "N/A", "na", "unknown", "undefined", "-")
TOKEN_FORM = r"^tok_[0-9a-f]{32}$"


def worthless_tokens() -> list[str]:
    """Tokens of constant digits and of plain digests of words that stand for no value."""
    digests = {hashlib.sha256(w.encode()).hexdigest()[:32] for w in EMPTY_WORDS} | {hashlib.md5(w.encode()).hexdigest() for w in EMPTY_WORDS}
    return sorted({f"tok_{d}" for d in digests} | {f"tok_{c * 32}" for c in "0123456789abcdef"})


def usable_token(c: Column) -> Column:
    return F.when(c.rlike(TOKEN_FORM) & ~c.isin(worthless_tokens()), c)


def split_tokens(value: str) -> list[str]:
    """Runs of letters and digits, and every other character on its own."""
    return re.findall(r"[^\W_]+|.", value, re.S)


def align(columns: list[dict[str, float]], tokens: list[str]) -> list[tuple[int | None, str]]:
    """Needleman-Wunsch of one value against the columns so far: (column or None for a new one, token) in order."""
    n, m = len(columns), len(tokens)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0] = -i
    for j in range(1, m + 1):
        score[0][j] = -j
    same = lambda i, j: 1.0 if tokens[j] in columns[i] else -1.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i][j] = max(score[i - 1][j - 1] + same(i - 1, j - 1), score[i - 1][j] - 1, score[i][j - 1] - 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + same(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((i, tokens[j]))
        elif j and score[i][j] == score[i][j - 1] - 1:
            j -= 1
            out.append((None, tokens[j]))
        else:
            i -= 1
            out.append((i, GAP))
    return out[::-1]


def consensus(values: list[str], weights: list[float]) -> str | None:
    """The value closest to the weighted vote over the progressive alignment; None for no values.

    Values come heaviest first. Distance is the weight of the columns in which a value's token is not the voted one;
    ties go to the heavier value, then to the lexically smaller one."""
    if not values:
        return None
    rows = [split_tokens(v) for v in values]
    if all(len(r) == len(rows[0]) for r in rows) and len(set(values)) == 1:
        return values[0]
    columns: list[dict[str, float]] = []
    aligned: list[list[str]] = []
    before = 0.0
    for tokens, w in zip(rows, weights, strict=True):
        placed = align(columns, tokens)
        new_columns, moved, mine = [], [], []
        for at, token in placed:
            if at is None:
                new_columns.append({GAP: before} if before else {})
                moved.append(None)
            else:
                new_columns.append(columns[at])
                moved.append(at)
            new_columns[-1][token] = new_columns[-1].get(token, 0.0) + w
            mine.append(token)
        aligned = [[GAP if at is None else row[at] for at in moved] for row in aligned] + [mine]
        columns, before = new_columns, before + w
    vote = [min(c, key=lambda t: (-c[t], t)) for c in columns]
    weight = [c[v] for c, v in zip(columns, vote, strict=True)]
    far = [sum(k for a, v, k in zip(row, vote, weight, strict=True) if a != v) for row in aligned]
    best = min(range(len(values)), key=lambda i: (far[i], -weights[i], values[i]))
    return values[best]


def survivors(df: DataFrame, key: str, fields: dict[str, Column], when: str, least: int = 2) -> DataFrame:
    """One row per key with `least` or more rows: key and the latest usable value of each field (null without one).

    fields: output name -> expression giving the usable value or null. Of values with one latest time the lexically
    smaller is taken; a null time is the oldest. Rows with a null key belong to no group. Repeated rows count as rows;
    other columns of df are not read; an empty table gives an empty one. Rows of a key and time are combined before the
    first shuffle and those of a key before the second, so a group of any size is spread over the tasks."""
    names = list(fields)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(when).alias("_when"), *[c.alias(n) for n, c in fields.items()])
    times = rows.groupBy("_key", "_when").agg(F.count(F.lit(1)).alias("_rows"), *[F.min(n).alias(n) for n in names])
    usable = lambda n: F.when(F.col(n).isNotNull(), F.struct("_when"))
    latest = times.groupBy("_key").agg(F.sum("_rows").alias("_rows"), *[F.max_by(n, usable(n)).alias(n) for n in names])
    return latest.where(F.col("_rows") >= least).select(F.col("_key").alias(key), *names)


def row_weight(trust: Column, parts: list[Column], when: Column, latest: Column) -> Column:
    """The weight of a row: its trust (null: one half) by its share of filled parts by its recency, which falls to a
    half a year before `latest` and never to nothing. No factor dominates: two rows can outvote a better one."""
    filled = sum((p.isNotNull().cast("double") for p in parts), F.lit(0.0)) / len(parts)
    years = F.greatest(F.datediff(latest, when), F.lit(0)) / 365.0
    weight = F.coalesce(trust.cast("double"), F.lit(0.5)) * (0.5 + filled / 2) * F.coalesce(1 / (1 + years), F.lit(0.1))
    return F.greatest(F.round(weight * UNIT), F.lit(1)).cast("bigint")


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("weight", T.LongType())]))
def _elect(lists: pd.Series) -> pd.DataFrame:
    out = []
    for entries in lists:
        ranked = sorted(((int(e["weight"]), e["value"]) for e in entries), key=lambda x: (-x[0], x[1]))
        best = consensus([v for _, v in ranked], [float(w) for w, _ in ranked])
        out.append((best, next(w for w, v in ranked if v == best)))
    return pd.DataFrame(out, columns=["value", "weight"])


def consensus_rows(df: DataFrame, key: str, fields: dict[str, Column], weight: Column, least: int = 2, block: int = BLOCK_VALUES) -> DataFrame:
    """One row per key with `least` or more rows: key and, of each field, the existing value closest to the consensus.

    fields: output name -> expression giving the usable value or null; weight: a positive whole number a row. Rows
    that agree in key, fields and weight vote once (a copy is no second witness); a value weighs what its rows do
    together. Ties go to the heavier, then to the lexically smaller value. A group with more than `block` values of a
    field is dealt to blocks by a hash; in each, all values vote, and the elected one goes on with its own weight until one
    block is left, so that no value is left out and no task holds an unbounded group. Rows with a null key belong to no
    group, a field without usable values is null, and an empty table gives an empty one."""
    names = list(fields)
    slim = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), weight.alias("weight"), *[c.alias(n) for n, c in fields.items()])
    sizes = slim.groupBy("_key").count().where(F.col("count") >= least).select("_key")
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names]))
    votes = slim.distinct().select("_key", "weight", entries.alias("e")).where("e.value is not null")
    votes = votes.groupBy("_key", "e.field", "e.value").agg(F.sum("weight").alias("weight"))
    votes = saved(votes.join(sizes, "_key", "left_semi"), "consensus-votes")
    while True:
        held = votes.groupBy("_key", "field").agg(F.count(F.lit(1)).alias("n"))
        most = held.agg(F.max("n")).first()[0] or 0
        if most <= block:
            break
        large = held.where(F.col("n") > block).select("_key", "field", F.ceil(F.col("n") / (block / 2)).alias("blocks"))
        dealt = votes.join(large, ["_key", "field"], "left").withColumn("_b", F.pmod(F.xxhash64("value", F.lit(math.ceil(most))), F.coalesce("blocks", F.lit(1))))
        alone = dealt.where("blocks is null").select("_key", "field", "value", "weight")
        met = dealt.where("blocks is not null").groupBy("_key", "field", "_b").agg(_entries().alias("e"))
        winners = met.select("_key", "field", _elect("e").alias("w")).groupBy("_key", "field", "w.value").agg(F.sum("w.weight").alias("weight"))
        votes = saved(alone.unionByName(winners), "consensus-votes")
    last = votes.groupBy("_key", "field").agg(_entries().alias("e")).select("_key", "field", _elect("e")["value"].alias("value"))
    wide = last.groupBy("_key").agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])
    return sizes.join(wide, "_key", "left").select(F.col("_key").alias(key), *names)


def _entries() -> Column:
    return F.collect_list(F.struct("weight", "value"))
