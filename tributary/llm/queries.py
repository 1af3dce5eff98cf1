"""Queries of the problems tagged llm (p2, p3, p4, p8, p9, p10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.values import key_text, squeeze
from tributary.llm.components import record_groups
from tributary.llm.consensus import consensus_rows, row_weight, survivors, usable_token
from tributary.llm.matching import match, profiles, with_confidence
from tributary.llm.packing import CAPACITY, pack
from tributary.llm.residue import residue
from tributary.llm.tokens import chunk_reuse, encode_corpus
from tributary.operators.flatten import path_steps, staged
from tributary.session import saved, table

#: Rows matched with less confidence than this say nothing about the customer.
LEAST_CONFIDENCE = "0.70"


def _tokens() -> dict[str, Column]:
    trusted = F.coalesce(F.col("match_confidence") >= F.lit(LEAST_CONFIDENCE).cast("decimal(3,2)"), F.lit(True))
    return {c: F.when(trusted, usable_token(F.col(c))) for c in ("email_token", "first_name_token", "last_name_token")}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer_id with two or more rows: the present value of each tokenised field."""
    return survivors(table(spark, sf_dir, "core_customers"), "customer_id", _tokens(), "updated_at")


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer_id with two or more rows: of each field the value closest to what its rows say together,
    weighed by trust, completeness and recency."""
    rows = table(spark, sf_dir, "core_customers")
    plain = {c: F.when(key_text(F.col(c)).isNotNull(), squeeze(F.col(c))) for c in ("company", "job_title", "city")}
    fields = {**_tokens(), **plain}
    latest = F.lit(rows.agg(F.max("updated_at")).first()[0])
    return consensus_rows(rows, "customer_id", fields, row_weight(F.col("match_confidence"), list(fields.values()), F.col("updated_at"), latest))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct source record of entity_index with the group of all that is tied to it."""
    source_id = key_text(F.col("source_id"))
    rows = table(spark, sf_dir, "entity_index").select(
        F.concat(F.coalesce(F.lower(squeeze(F.col("source"))), F.lit("")), F.lit("\x1f"), source_id).alias("record"),
        key_text(F.col("unified_id")).alias("id"),
        key_text(F.col("linked_to_unified_id")).alias("linked"),
    )
    part = lambda i: F.split_part("record", F.lit("\x1f"), F.lit(i))
    return record_groups(rows).select(F.nullif(part(1), F.lit("")).alias("source"), part(2).alias("source_id"), "group_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), counts=True)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens assigned to containers of 2,048 tokens: one row a document, or a piece of a longer one."""
    packed = pack(document_sizes(spark, sf_dir), "doc_id", "n_tokens")
    return packed.select("container", F.col("id").cast("bigint").alias("doc_id"), "part", F.col("size").alias("n_tokens"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on p9_containers: containers over the capacity, tokens and documents packed that should not or should be,
    and whether the containers are at most one in a hundred more than the total size asks for."""
    sizes = saved(document_sizes(spark, sf_dir).where("n_tokens > 0"), "p9-sizes")
    packed = saved(pack(sizes, "doc_id", "n_tokens"), "p9-packed")
    fill = packed.groupBy("container").agg(F.sum("size").alias("fill"))
    held = fill.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("fill") > CAPACITY).cast("bigint")).alias("over_full"), F.sum("fill").alias("tokens"))
    want = sizes.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("total"))
    docs = packed.select("id").distinct().agg(F.count(F.lit(1)).alias("documents_packed"))
    least = F.ceil(F.col("total") / CAPACITY)
    one = [x.withColumn("_one", F.lit(1)) for x in (held, want, docs)]
    return one[0].join(one[1], "_one").join(one[2], "_one").select(
        F.coalesce("over_full", F.lit(0)).alias("over_full"), F.coalesce(F.col("tokens") - F.col("total"), F.lit(0)).alias("tokens_changed"), "documents_packed",
        F.coalesce(F.col("n") <= F.ceil(least * 1.01), F.lit(True)).alias("near_bound"),
    )


def p8_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and bytes of the corpus, and those of its distinct chunks."""
    return chunk_reuse(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are template residue, filler or an error page."""
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of such documents by kind."""
    return residue(table(spark, sf_dir, "documents")).groupBy("kind").agg(F.count(F.lit(1)).cast("bigint").alias("documents"))


def p10_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without them."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(residue(docs).select("doc_id"), "doc_id", "left_anti")


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "shopify_customers").select("id", "email", F.col("first_name").alias("first"), F.col("last_name").alias("last"), "phone")
    return profiles(rows.distinct())


def subscriber_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and a second phone are in merge_fields."""
    rows = table(spark, sf_dir, "mailchimp_subscribers").select(F.lower(F.trim("subscriber_id")).alias("id"), F.col("email_address").alias("email"), "phone", "merge_fields").distinct()
    rows = staged(rows, "merge_fields", *path_steps("merge_fields", upper_first=True, depth=1))
    value = lambda k: F.get(F.filter("merge_fields", lambda e: e["key"] == k), F.lit(0))["value"]
    phones = F.explode_outer(F.array_distinct(F.array(F.col("phone"), value("PHONE"))))
    return profiles(rows.select("id", "email", value("FNAME").alias("first"), value("LNAME").alias("last"), phones.alias("phone")))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(customer_profiles(spark, sf_dir), subscriber_profiles(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of a customer and a subscriber who are the same person."""
    return matched(spark, sf_dir).select(F.col("a_id").cast("bigint").alias("customer_id"), F.col("b_id").alias("subscriber_id"))


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with the rule that found them and its confidence; labels are the records of entity_index."""
    index = table(spark, sf_dir, "entity_index").where("source in ('shopify_customers', 'mailchimp_subscribers')")
    labels = index.select(F.when(F.col("source") == "shopify_customers", "a").otherwise("b").alias("side"), key_text(F.col("source_id")).alias("id"), key_text(F.col("unified_id")).alias("entity"))
    pairs = with_confidence(saved(matched(spark, sf_dir), "p2-pairs"), labels)
    return pairs.select(F.col("a_id").cast("bigint").alias("customer_id"), F.col("b_id").alias("subscriber_id"), "rule", F.round("confidence", 4).alias("confidence"))
