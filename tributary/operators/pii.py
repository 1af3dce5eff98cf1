"""Tokenisation of direct identifiers at the staging boundary, with a vault and an access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("email", "phone", "name", "name_prefix", "address", "mailchimp_id")


def normalize(c: Column, pii_class: str) -> Column:
    """The form of a value that tokens are made of; blank and too short values are null."""
    if pii_class not in CLASSES:
        raise ValueError(f"unknown class {pii_class!r}")
    if pii_class == "phone":
        v = F.regexp_replace(c, r"[^0-9+]", "")
        return F.when(F.length(v) >= 7, v)
    v = F.lower(F.substring(c, 1, 3)) if pii_class == "name_prefix" else F.lower(F.trim(c))
    return F.nullif(v, F.lit(""))


def token(normalized: Column, pii_class: str, pepper: str) -> Column:
    """tok_ and 32 hex digits of a keyed digest; null for null. One value has different tokens in different classes."""
    if not pepper:
        raise ValueError("tokenisation needs a pepper")
    digest = F.sha2(F.concat_ws("|", F.lit(pepper), F.lit(pii_class), normalized), 256)
    return F.when(normalized.isNotNull(), F.concat(F.lit("tok_"), F.substring(digest, 1, 32)))


def tokens_only(df: DataFrame, columns: dict[str, str], pepper: str) -> DataFrame:
    """df with `<column>_token` in the place of each column that it has; for streams too."""
    made = [token(normalize(F.col(c), k), k, pepper).alias(f"{c}_token") for c, k in columns.items() if c in df.columns]
    return df.select(*[c for c in df.columns if c not in columns], *made)


def tokenize_frame(df: DataFrame, columns: dict[str, str], pepper: str, key_version: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """(df with `<column>_token` in the place of each column, vault rows (token, pii_class, value, key_version)).

    columns: column -> class. Plain text leaves the frame here; the vault rows of all columns come from one scan and are
    unique by token. Without any of the columns the frame is returned as it is, with no vault."""
    present = {c: k for c, k in columns.items() if c in df.columns}
    if not present:
        return df, None
    made = {c: token(normalize(F.col(c), k), k, pepper) for c, k in present.items()}
    out = tokens_only(df, present, pepper)
    entries = F.array(*[F.struct(made[c].alias("token"), F.lit(k).alias("pii_class"), normalize(F.col(c), k).alias("value")) for c, k in present.items()])
    vault = df.select(F.inline(F.filter(entries, lambda x: x["token"].isNotNull()))).groupBy("token").agg(F.min("pii_class").alias("pii_class"), F.min("value").alias("value"))
    return out, vault.withColumn("key_version", F.lit(key_version))


def vault_additions(vault: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` whose token the vault lacks, one a token: what an insert-only upsert appends."""
    return new.dropDuplicates(["token"]).join(vault.select("token"), "token", "left_anti")


def lookup(vault: DataFrame, tokens: DataFrame) -> DataFrame:
    """The vault's rows of the given tokens; unknown tokens give no row."""
    return vault.join(tokens.select("token").distinct(), "token", "left_semi")


def detokenize(vault: DataFrame, tokens: DataFrame, actor: str, reason: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(vault rows, one audit row). Actor and reason must be given; the class is null if tokens are of several."""
    if not (actor or "").strip() or not (reason or "").strip():
        raise ValueError("actor and reason must be given")
    found = lookup(vault, tokens)
    audit = found.agg(
        F.lit(actor).alias("actor"),
        F.lit(reason).alias("reason"),
        F.lit(at).cast("timestamp").alias("accessed_at"),
        F.count(F.lit(1)).alias("found"),
        F.when(F.count_distinct("pii_class") == 1, F.min("pii_class")).alias("pii_class"),
    )
    return found, audit


def null_rates(df: DataFrame) -> DataFrame:
    """One row: the share of nulls of each column, in one pass; null for an empty table."""
    n = F.count(F.lit(1))
    return df.agg(*[F.round(F.try_divide(F.sum(F.col(f"`{c}`").isNull().cast("double")), n.cast("double")), 6).alias(c) for c in df.columns])
