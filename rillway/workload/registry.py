"""The named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillway.streaming.runner import checkpoint_root

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """tables.orders reads orders.parquet of the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def scratch(t: Tables) -> str:
    """A new folder in the shared checkpoint folder. Where none is set, a local master gets a temporary one."""
    master = t.spark.sparkContext.master
    local = master == "local" or master.startswith("local[")
    return f"{checkpoint_root(t.spark, tempfile.mkdtemp(prefix='rillway-') if local else None)}/{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with its SQL counterpart."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
