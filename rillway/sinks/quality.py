"""Dead letters, run metrics and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rillway.columns import ALIAS, doc_columns, quoted
from rillway.sinks.writers import TARGET_SET

LETTER = ("stage", "reason", "alias", "doc_json")


def dead_letters(df: DataFrame, stage: str, reason: str | Column, *keep: str) -> DataFrame:
    """Failed rows as (kept columns, stage, reason, alias, doc_json)."""
    alias = quoted(ALIAS) if ALIAS in df.columns else F.lit("")
    body = F.struct(*[quoted(c) for c in doc_columns(df) if c not in keep])
    return df.select(
        *[quoted(k) for k in keep],
        F.lit(stage).alias("stage"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        alias.alias("alias"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("doc_json"),
    )


def latest_letters(letters: DataFrame, pos: str, n: int = 100) -> DataFrame:
    """The last n dead letters, newest first."""
    return letters.orderBy(F.desc(pos)).limit(n)


def run_metrics(
    df: DataFrame, pipeline_failed: Column, delivery_failed: Column, by: list[str] = (), extra: list[Column] = ()
) -> DataFrame:
    """Rows read, failures by stage and rows delivered; filtered rows count as delivered. extra holds
    further aggregates of the same pass."""
    read = F.count(F.lit(1))
    failed_pipeline = F.count_if(pipeline_failed)
    failed_delivery = F.count_if(delivery_failed)
    return df.groupBy(*[quoted(c) for c in by]).agg(
        read.alias("full_read_count"),
        (read - failed_pipeline - failed_delivery).alias("full_delivery_count"),
        failed_delivery.alias("failed_delivery_count"),
        failed_pipeline.alias("failed_pipeline_count"),
        *extra,
    )


def rows_per_second(count: Column, seconds: Column) -> Column:
    """Whole rows per second as the text "n/s"; 0 for runs shorter than a second."""
    rate = F.when(seconds > 0, F.floor(count / seconds)).otherwise(F.lit(0).cast("bigint"))
    return F.concat(rate.cast("string"), F.lit("/s"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while the job that writes them runs, without a second pass."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def observed_aliases(df: DataFrame, name: str, aliases: list[str]) -> tuple[DataFrame, Observation]:
    """Count the rows of each alias ("rows 0", ...) while the job that writes them runs."""
    return _observed_by(df, name, ALIAS, aliases)


def observed_sets(df: DataFrame, name: str, sets: list[str]) -> tuple[DataFrame, Observation]:
    """Count the rows of each target set ("rows 0", ...) while the job that writes them runs."""
    return _observed_by(df, name, TARGET_SET, sets)


def _observed_by(df: DataFrame, name: str, by: str, values: list[str]) -> tuple[DataFrame, Observation]:
    observation = Observation(name)
    return df.observe(observation, *[F.count_if(quoted(by) == v).alias(f"rows {i}") for i, v in enumerate(values)]), observation


COUNTS = ("full_read_count", "full_delivery_count", "failed_delivery_count", "failed_pipeline_count")
COUNT_SCHEMA = "alias string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def observed_letters(letters: DataFrame, name: str, aliases: list[str]) -> tuple[DataFrame, Observation]:
    """Dead letters counted by alias and stage while they are written."""
    observation = Observation(name)
    of = lambda alias, stage: F.count_if((F.col("alias") == alias) & (F.col("stage") == stage))
    counts = [of(a, s).alias(f"{s} {i}") for i, a in enumerate(aliases) for s in ("delivery", "pipeline")]
    return letters.observe(observation, *counts), observation


def count_row(alias: str, read: int, delivery: int, pipeline: int) -> tuple:
    """The counts of one alias; filtered rows count as delivered."""
    return alias, read, read - delivery - pipeline, delivery, pipeline


def health(state: Column, new_delivery_failures: Column) -> Column:
    """red when stopped; when running yellow after new delivery failures, else green; none in other states."""
    running = F.when(new_delivery_failures > 0, F.lit("yellow")).otherwise(F.lit("green"))
    return F.when(state == "stop", F.lit("red")).when(state == "run", running).otherwise(F.lit("none"))
