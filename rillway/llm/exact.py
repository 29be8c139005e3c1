"""Exact deduplication: deduplicate locally, merge salted digest groups, combine the salts' winners.

Every stage groups by digest *and* full normalised text, so equal digests alone never make two texts equal. The first
grouping combines map-side, so a group of any size leaves one row per task, and its salts spread those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import SPACES, numbered, row_order, saved

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", " ")


def winners(docs: DataFrame, digest=lambda text: F.sha2(text, 256), salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, text, keep_id (smallest doc_id, null if all are), group_size."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    local = rows.groupBy("digest", "text", salt).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return local.groupBy("digest", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, digest=lambda text: F.sha2(text, 256), salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and row, for each row of docs (doc_id, text; others are ignored).

    Null texts count as empty. A null doc_id is kept only in a group without any other id. Of repeated rows with the
    winning doc_id one is kept. Members find their group by the digest; only where texts differ under one digest is
    the text needed too, and then for those digests alone.
    """
    text = normalised(F.col("text"))
    members = saved(numbered(docs, "doc_id", digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256")), "exact-members")
    best = winners(docs, digest, salts)
    groups = saved(best.select("digest", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")), "exact-groups")
    # Under one digest, the texts are told apart by SHA-256; that it tells all of them apart is checked, not assumed.
    same = groups.groupBy("digest", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    if not same.isEmpty():
        raise ValueError("different texts share one SHA-256")
    found = members.join(groups, ["digest", "text_sha256"])
    first = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "text_sha256").agg(F.min("row").alias("row"))
    first = first.select("row", F.lit(True).alias("first"))
    return found.join(first, "row", "left").select(
        "doc_id", "keep_id", "group_size", F.coalesce("first", F.lit(False)).alias("kept"), "text_sha256", "row"
    )


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, one per distinct text: the one with the smallest doc_id. All columns are returned."""
    id_key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  a group without any id keeps a row too
    groups = winners(docs, salts=salts).select("digest", id_key("keep_id").alias("id_key"))
    rows = docs.select(F.struct("*").alias("row"), id_key("doc_id").alias("id_key"), F.sha2(normalised(F.col("text")), 256).alias("digest"))
    one = Window.partitionBy("digest", "id_key").orderBy(row_order(docs, "row"))  # repeated rows; dealt as the join is
    kept = rows.join(groups, ["digest", "id_key"], "left_semi").withColumn("n", F.row_number().over(one))
    return kept.where("n = 1").select("row.*")
