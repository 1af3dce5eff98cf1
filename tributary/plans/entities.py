"""The entity pipeline after exact matching, on customers and suppliers as two sources of people.

Customers and the suppliers with an e-mail are in the index; the other suppliers are matched to its entities by blocking and a fuzzy score, and those
without a match become entities of their own. The blocking index, one row an entity and orders with their unified
customer follow from the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import entity, windows
from tributary.operators.skew import lookup_join
from tributary.plans.tables import sessions
from tributary.session import saved, table

SYLLABLES = ("an", "bel", "cor", "dun", "er", "fal", "gar", "hol", "in", "jar", "kel", "lor", "mon", "nor", "ol", "par", "quin", "ros", "sel", "tor")
ROADS = ("Street", "Avenue", "Road", "Lane", "North Drive", "Court")
THRESHOLD = 0.85


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier and the customer of the same number share name and address but for the spelling of the road; tokens
    of e-mail and phone are shared by nation and the end of the number."""

    def source(name: str, key: str, nation: str) -> DataFrame:
        k, n = F.col(key), F.col(nation)
        last = F.concat(_pick(SYLLABLES, k % 20), _pick(SYLLABLES, F.floor(k / 20) % 20), F.substring(F.md5(k.cast("string")), 1, 1))
        road = _pick(ROADS, k % 6) if name == "customer" else F.lower(_pick(ROADS, k % 6))
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("source"), k.cast("string").alias("source_id"), F.when(k % 10 != 0, F.concat_ws("-", n.cast("string"), (k % 100).cast("string"))).otherwise(" ").alias("email_token"),
            F.when(k % 4 == 0, F.concat(F.lit("tok"), (k % 1000).cast("string"))).otherwise("short").alias("phone_token"), F.concat(F.lit("Kim "), F.initcap(last)).alias("full_name"), last.alias("last_name"),
            F.concat((k % 90).cast("string"), F.lit(" "), road, F.lit(", No. "), (k % 7).cast("string")).alias("address"), F.lpad((k % 1000).cast("string"), 5, "0").alias("zip"), k.alias("staged_at"),
        )

    return source("customer", "c_custkey", "c_nationkey").unionByName(source("supplier", "s_suppkey", "s_nationkey"))


def known_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index before this run: all customers, and the suppliers with an e-mail."""
    return entity.resolve_exact(people(spark, sf_dir).where("source = 'customer' or trim(email_token) <> ''"))


def entity_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.unresolved(people(spark, sf_dir), known_index(spark, sf_dir)).select("source", "source_id")


def entity_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and addresses of the entities in the index."""
    return entity.entity_profiles(known_index(spark, sf_dir), people(spark, sf_dir)).select("unified_id", "full_name", "zip", entity.normalize_address(F.col("address")).alias("address")).distinct()


def _candidates(spark: SparkSession, sf_dir: str, blocks: list[str]) -> DataFrame:
    """Pairs of an unresolved record and a known one that share the zip, or the sound of the last name."""
    p = people(spark, sf_dir).withColumn("record", F.concat_ws(":", "source", "source_id")).withColumn("sound", F.soundex("last_name")).withColumn("address", entity.normalize_address(F.col("address")))
    new = saved(entity.unresolved(p, known_index(spark, sf_dir)), "entity-new")
    old = saved(entity.entity_profiles(known_index(spark, sf_dir), p), "entity-old")
    side = lambda df, s: df.select(F.col("record").alias(f"{s}_id"), F.lower(F.trim("full_name")).alias(f"{s}_name"), F.col("address").alias(f"{s}_address"), *[F.col(b).alias(f"{s}_{b}") for b in blocks], *(["unified_id"] if s == "r" else []))
    left, right = side(new, "l"), side(old, "r")
    pairs = entity.blocked_pairs(left, right, "l_id", "r_id", [(F.col(f"l_{b}"), F.col(f"r_{b}")) for b in blocks])
    return pairs.join(left, "l_id").join(right, "r_id")


def _fuzzy(spark: SparkSession, sf_dir: str, blocks: list[str]) -> DataFrame:
    pairs = saved(_candidates(spark, sf_dir, blocks), "entity-pairs")
    best = entity.fuzzy_matches(pairs, "l_id", "r_id", THRESHOLD)
    ids = pairs.select("r_id", "unified_id").distinct()
    return best.join(ids, "r_id").select("l_id", "unified_id", F.col("r_id").alias("matched_id"), "score")


def fuzzy_by_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best known record of each unresolved one in the same zip, by name and address."""
    return _fuzzy(spark, sf_dir, ["zip"])


def entity_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows this run adds to the index: fuzzy matches by sound or zip, and new entities for the rest."""
    found = saved(_fuzzy(spark, sf_dir, ["sound", "zip"]).select("unified_id", F.split_part("l_id", F.lit(":"), F.lit(1)).alias("source"), F.split_part("l_id", F.lit(":"), F.lit(2)).alias("source_id"), F.lit("fuzzy_name").alias("match_type")), "entity-found")
    return found.unionByName(entity.new_entities(entity_unresolved(spark, sf_dir), found))


def blocking_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking keys of every entity from the index and one conformed table of profiles."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    keys = {"email": blank("email_token"), "phone": F.when(F.length("phone_token") >= 6, F.col("phone_token")), "name_zip": F.concat_ws("_", F.lower(F.substring("last_name", 1, 3)), "zip")}
    return entity.blocking_index(known_index(spark, sf_dir), people(spark, sf_dir), keys, "email")


def entity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.pivoted(known_index(spark, sf_dir), ["customer", "supplier"])


def unified_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an entity with what its sources say of it: the supplier's name wins, balances are set side by side."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), "c_name", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("supplier_id"), "s_name", "s_acctbal")
    rows = entity_pivot(spark, sf_dir).join(c, "customer_id", "left").join(s, "supplier_id", "left")
    return rows.select("unified_id", "customer_id", "supplier_id", "source_count", F.coalesce("s_name", "c_name").alias("name"), F.least("c_acctbal", "s_acctbal").alias("low_balance"), F.greatest("c_acctbal", "s_acctbal").alias("high_balance"))


def orders_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the entity of their customer; orders of a customer the index lacks keep a null."""
    ids = known_index(spark, sf_dir).where("source = 'customer'").select("unified_id", F.col("source_id").alias("customer_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer_id"))
    return lookup_join(orders, ids, "customer_id").select("o_orderkey", "customer_id", "unified_id")


def profile_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest session."""
    s = sessions(spark, sf_dir).select("user_id", "sess_num", "session_start", "session_end", "events")
    return windows.latest_per_key(s, ["user_id"], ["session_start", "sess_num"])


def entity_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_index(spark, sf_dir).groupBy("match_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("unified_id").alias("entities"))


def repeated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records under several ids, with the ids in order; those of one source that shares an entity likewise."""
    i = table(spark, sf_dir, "entity_index").where("source_id is not null and source is not null and unified_id is not null")
    ids = F.sort_array(F.collect_set("unified_id"))
    return i.groupBy("source", "source_id").agg(F.count_distinct("unified_id").alias("n_ids"), F.array_join(ids, ",").alias("ids")).where("n_ids > 1")


def cross_source_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "entity_index").where("source is not null and unified_id is not null")
    return i.groupBy("unified_id").agg(F.count_distinct("source").alias("n_sources"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources")).where("n_sources > 1")


NAMES = [
    "entity_unresolved", "entity_existing", "fuzzy_by_zip", "entity_pipeline", "blocking_rebuilt", "entity_pivot", "unified_customers", "orders_unified",
    "profile_sessions", "entity_methods", "repeated_records", "cross_source_entities",
]
QUERIES = {n: globals()[n] for n in NAMES}
