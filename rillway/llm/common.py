"""Helpers shared by the operators: reading, stage tables, salted joins, distributed running sums."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillway.columns import has_map

#: The white space of every contract, space and \t \n \v \f \r. bytes.split() uses the same six.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master
    (tests) gets a temporary folder; a cluster is refused, since its machines do not share one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), f"rillway-{spark.sparkContext.applicationId}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: later plans start there, a lost executor costs no recomputation,
    and values such as row numbers stay what they are."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_order(df: DataFrame, row: str) -> Column:
    """A hash of the struct `row`, which holds all columns of df: equal for repeated rows only (but for hash collisions)."""
    return F.xxhash64(F.col(row).cast("string") if has_map(df.schema) else F.col(row))


def numbered(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns with a row number "row"; unique, not consecutive. Stable only once saved."""
    return df.select(*columns, F.monotonically_increasing_id().alias("row"))


BROADCAST_ROWS = 1_000_000


def checked_broadcast(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table of a few numbers a row, for broadcast if it has `most` rows or fewer, else for a shuffled join."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, salts: int = 16, how: str = "inner"):
    """Join a side with hot keys to one with unique keys: rows of the left are dealt over `salts` parts of their key,
    rows of the right are repeated once per part. Keys match null with null only where the caller has replaced nulls."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def running_sum(df: DataFrame, group: str, order: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` within `group`. `bucket` must rise with `order`, so that a group of any size is
    cut into buckets that are summed apart; only one row per bucket meets in a group's window."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [group, bucket])
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_start", "_inside")
    )
