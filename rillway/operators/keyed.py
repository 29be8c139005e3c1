"""Batch writes to a keyed table: insert, update by key, delete by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.columns import quoted


def insert_rows(target: DataFrame, batch: DataFrame, keys: list[str], pos: str) -> tuple[DataFrame, DataFrame]:
    """Plain inserts in order of pos. Returns the new target and the refused rows: those whose key the
    target has already, and all but the first of a key repeated in the batch."""
    rest = [c for c in batch.columns if c not in keys and c != pos]
    firsts = (
        batch.groupBy(*[quoted(k) for k in keys])
        .agg(F.min(F.struct(quoted(pos), *[quoted(c) for c in rest])).alias("__row"))
        .select(*[quoted(k) for k in keys], "__row.*")
    )
    known = target.select(*[quoted(k) for k in keys])
    accepted = firsts.join(known, keys, "left_anti")
    new_target = target.unionByName(accepted.select(*[quoted(c) for c in target.columns]))
    taken = accepted.select(*[quoted(k) for k in keys], quoted(pos))
    refused = batch.join(taken, [*keys, pos], "left_anti").withColumn("reason", F.lit("duplicate key"))
    return new_target, refused


def update_rows(target: DataFrame, batch: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Set the batch's columns on the rows with its keys, the last change of a key winning. Keys the
    target lacks and rows with a null key change nothing. The key is that of the row after the change,
    so a changed key updates whatever row has the new one (see fold.split_key_changes otherwise)."""
    columns = [c for c in batch.columns if c in target.columns and c not in keys]
    latest = _last_per_key(batch, keys, pos, columns, "__n_")
    joined = target.join(latest.withColumn("__hit", F.lit(True)), keys, "left")
    return joined.select(
        *[
            F.when(F.col("__hit"), quoted("__n_" + c)).otherwise(quoted(c)).alias(c) if c in columns else quoted(c)
            for c in target.columns
        ]
    )


def _last_per_key(batch: DataFrame, keys: list[str], pos: str, columns: list[str], prefix: str = "") -> DataFrame:
    last = F.max(F.struct(quoted(pos).alias("__at"), *[quoted(c).alias(prefix + c) for c in columns]))
    return (
        batch.groupBy(*[quoted(k) for k in keys]).agg(last.alias("__row"))
        .select(*[quoted(k) for k in keys], "__row.*").drop("__at")
    )


def delete_rows(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    # distinct combines map-side: a key repeated all over the batch is shuffled once per task
    return target.join(batch.select(*[quoted(k) for k in keys]).distinct(), keys, "left_anti")
