"""Entity resolution on conformed profiles: exact by token, blocked and fuzzy, golden record, quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators.skew import lookup_join, salted_join

NAME_WEIGHT, ADDRESS_WEIGHT, THRESHOLD = 0.7, 0.3, 0.85


def unified_id(token: Column, source: Column, source_id: Column) -> Column:
    """Deterministic id of an entity: by its token, or by its own record where there is no token."""
    own = F.concat_ws("|", source, source_id)
    return F.concat(F.lit("U-"), F.substring(F.sha2(F.coalesce(F.nullif(F.trim(token), F.lit("")), own), 256), 1, 32))


def resolve_exact(profiles: DataFrame) -> DataFrame:
    """entity index of profiles (source, source_id, email_token, staged_at): records of one non-blank token share an
    id; the first staged is `new_entity`, the others `exact_email`. A blank token makes an entity of its own, and such
    records are ranked by their own id, so they form no group together. The first of each entity is found by an
    aggregation and looked up, so that a token shared by a third of all records is no single task."""
    uid = unified_id(F.col("email_token"), F.col("source"), F.col("source_id"))
    rows = profiles.select(uid.alias("unified_id"), "source", "source_id", "staged_at")
    at = F.struct("staged_at", "source", "source_id")
    first = rows.groupBy("unified_id").agg(F.min(at).alias("_first"))
    kind = F.when(F.col("_first") == at, "new_entity").otherwise("exact_email")
    return lookup_join(rows, first, "unified_id").select("unified_id", "source", "source_id", kind.alias("match_type"), F.lit(1.0).cast("decimal(3,2)").alias("match_confidence"))


def blocking_keys(profiles: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(blocking_key, blocking_key_type, source, source_id), one row a non-null key: all kinds in a single scan."""
    made = F.array(*[F.struct(F.concat(F.lit(f"{k}:"), c).alias("blocking_key"), F.lit(k).alias("blocking_key_type")) for k, c in keys.items()])
    kept = F.filter(made, lambda x: x["blocking_key"].isNotNull())
    return profiles.select("source", "source_id", F.explode(kept).alias("k")).select("k.blocking_key", "k.blocking_key_type", "source", "source_id")


def blocked_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, blocks: list[tuple[Column, Column]]) -> DataFrame:
    """Distinct (left_id, right_id) of rows that agree in any block: an OR of equalities as one equi-join on exploded
    keys. Null keys agree with nothing. Hot keys of the left side are salted, so no task joins a whole block."""

    def keyed(df: DataFrame, ident: str, side: int) -> DataFrame:
        keys = F.array(*[F.when(b[side].isNotNull(), F.concat(F.lit(f"{i}:"), b[side].cast("string"))) for i, b in enumerate(blocks)])
        return df.select(ident, F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("_block"))

    return salted_join(keyed(left, left_id, 0), keyed(right, right_id, 1), "_block", left_id).select(left_id, right_id).distinct()


def _codes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points padded by zeros (one column at least), and lengths."""
    lengths = texts.str.len().to_numpy(np.int64)
    out = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def jaro_winkler(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaro-Winkler of pairs, with the boost of a common prefix (up to 4, scale 0.1) always applied; 0 with a null.

    All pairs are worked together, one place of the left texts at a time: a place takes the first free equal letter
    of the right text within reach."""
    known = (a.notna() & b.notna()).to_numpy()
    equal = known & (a.to_numpy(object) == b.to_numpy(object))
    (x, n), (y, m) = (_codes(s.fillna("").str.lower().str.strip()) for s in (a, b))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    places = np.arange(y.shape[1])
    free, hit = places < m[:, None], np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        fits = free & (y == x[:, i : i + 1]) & (np.abs(places - i) <= reach[:, None]) & (i < n)[:, None]
        at = fits.argmax(1)
        hit[:, i] = fits[np.arange(len(fits)), at]
        free[hit[:, i], at[hit[:, i]]] = False
    taken = ~free & (places < m[:, None])
    hits = hit.sum(1)
    order = lambda z, flags: np.sort(np.where(flags, np.arange(z.shape[1]), z.shape[1]), 1)
    width = int(hits.max(initial=0))
    read = lambda z, flags: np.take_along_axis(z, np.minimum(order(z, flags)[:, :width], z.shape[1] - 1), 1)
    swaps = ((read(x, hit) != read(y, taken)) & (np.arange(width) < hits[:, None])).sum(1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(hits > 0, (hits / n + hits / m + (hits - swaps) / hits) / 3, 0.0)
    w = min(4, x.shape[1], y.shape[1])
    same = (x[:, :w] == y[:, :w]) & (np.arange(w) < np.minimum(n, m)[:, None])
    prefix = np.logical_and.accumulate(same, 1).sum(1)
    score = np.where(hits > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)
    return np.where(equal, 1.0, np.where(known, score, 0.0))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winkler(a, b))


#: Words of an address and what they are shortened to, in order, wherever they stand.
ADDRESS_WORDS = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "lane": "ln", "court": "ct",
    "apartment": "apt", "suite": "ste", "north": "n", "south": "s", "east": "e", "west": "w",
}
ADDRESS_MARKS = ".,#-"


def normalize_address(c: Column) -> Column:
    """Lower case, shortened words, no marks, single blanks; an empty text for null."""
    out = F.lower(c)
    for word, short in ADDRESS_WORDS.items():
        out = F.replace(out, F.lit(word), F.lit(short))
    return F.coalesce(F.trim(F.regexp_replace(F.translate(out, ADDRESS_MARKS, " " * len(ADDRESS_MARKS)), r"\s+", " ")), F.lit(""))


def address_similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer; 0 where either is blank."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def fuzzy_matches(pairs: DataFrame, left_id: str, right_id: str, threshold: float = THRESHOLD) -> DataFrame:
    """Best match of each left row: pairs with l_name, r_name, l_address, r_address; ties go to the smaller right id.
    The Python score is computed on blocked pairs only, in Arrow batches, and compared at six digits."""
    score = NAME_WEIGHT * name_similarity("l_name", "r_name") + ADDRESS_WEIGHT * address_similarity(F.col("l_address"), F.col("r_address"))
    scored = pairs.withColumn("score", F.round(score, 6)).where(F.col("score") >= threshold)
    best = scored.groupBy(left_id).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(right_id).alias("r"))).alias("m"))
    return best.select(left_id, F.col("m.r").alias(right_id), (-F.col("m.s")).alias("score"))


def unresolved(profiles: DataFrame, index: DataFrame) -> DataFrame:
    """The profiles whose record the index lacks."""
    return profiles.join(index.select("source", "source_id"), ["source", "source_id"], "left_anti")


def entity_profiles(index: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profiles of the index's records with their entity's id; repeated rows count once."""
    return index.select("unified_id", "source", "source_id").distinct().join(profiles, ["source", "source_id"])


def new_entities(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """(unified_id, source, source_id, match_type) of rows no match was found for: each an entity of its own record."""
    left = rows.join(matched.select("source", "source_id"), ["source", "source_id"], "left_anti")
    return left.select(unified_id(F.lit(""), F.col("source"), F.col("source_id")).alias("unified_id"), "source", "source_id", F.lit("new_entity").alias("match_type"))


def blocking_index(index: DataFrame, profiles: DataFrame, keys: dict[str, Column], primary: str) -> DataFrame:
    """(blocking_key, blocking_key_type, unified_id, is_primary), distinct: the blocking keys of every entity, rebuilt
    from the index and one conformed profile table. is_primary: keys of the kind `primary`."""
    made = F.array(*[F.struct(F.concat(F.lit(f"{k}:"), c).alias("blocking_key"), F.lit(k).alias("blocking_key_type")) for k, c in keys.items()])
    rows = entity_profiles(index, profiles).select("unified_id", F.explode(F.filter(made, lambda x: x["blocking_key"].isNotNull())).alias("k"))
    return rows.select("k.blocking_key", "k.blocking_key_type", "unified_id", (F.col("k.blocking_key_type") == primary).alias("is_primary")).distinct()


def pivoted(index: DataFrame, sources: list[str]) -> DataFrame:
    """One row an entity: of each source its largest record id, and in how many sources it occurs."""
    ids = [F.max(F.when(F.col("source") == s, F.col("source_id"))).alias(f"{s}_id") for s in sources]
    return index.groupBy("unified_id").agg(*ids, F.count_distinct("source").alias("source_count"))


def golden_record(df: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """One row a key: per field the first non-null value under `order` (trusted source first), of equals the smallest."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_value")))).alias(c) for c in fields])


def quality(index: DataFrame) -> DataFrame:
    """One row of an entity index's health: sizes, records under several ids, entities in several sources."""
    by_record = index.groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unified_id").alias("ids"))
    by_entity = index.groupBy("unified_id").agg(F.count_distinct("source").alias("sources"))
    a = by_record.agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("rows"), F.sum((F.col("n") > 1).cast("bigint")).alias("repeated_records"), F.sum((F.col("ids") > 1).cast("bigint")).alias("split_records"))
    b = by_entity.agg(F.count(F.lit(1)).alias("entities"), F.sum((F.col("sources") > 1).cast("bigint")).alias("cross_source_entities"))
    return a.withColumn("_j", F.lit(1)).join(b.withColumn("_j", F.lit(1)), "_j").drop("_j")


def cardinality_histogram(index: DataFrame, top: int = 4) -> DataFrame:
    """(records, entities): how many entities have 1, 2, ... records, the last bucket holding `top` and more."""
    sizes = index.groupBy("unified_id").agg(F.least(F.count(F.lit(1)), F.lit(top)).alias("records"))
    return sizes.groupBy("records").agg(F.count(F.lit(1)).alias("entities"))
