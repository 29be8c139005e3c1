"""Queries that run a stream to its end and return what it left behind."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rillway.columns import OP, POS, PRESENT
from rillway.operators.relate import relate
from rillway.sinks.target import KeyedTarget
from rillway.sources import structure
from rillway.sources.messages import parse_queue
from rillway.streaming import runner
from rillway.workload.joins import as_json, on
from rillway.workload.registry import Tables, query, scratch
from rillway.workload.sinks import EVENT_LOG_SQL, INDEX_FOLD_SQL, fold_table_sql, supplied_fields
from rillway.workload.sources import event_op, queue_messages


def stream_of(t: Tables, name: str):
    """One of the tables, a file or a folder of files, as a file stream."""
    schema = getattr(t, name).schema
    # a pattern that fits this one name: of a plain path Spark asks that it be a folder
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}.parque[t]")


def run(query_handle) -> None:
    query_handle.awaitTermination()


@query("stream_apply_changes", fold_table_sql(EVENT_LOG_SQL, "user_id", "event_type, value, props"))
def stream_apply_changes(t: Tables):
    folder = scratch(t)
    target = KeyedTarget(t.spark, f"{folder}/users", ["user_id"], ["event_type", "value", "props"])
    changes = stream_of(t, "events").select(
        "user_id", F.col("event_id").alias("pos"), event_op().alias("op"), "event_type", "value", "props"
    )
    run(runner.start_apply(changes, target, f"{folder}/checkpoint", once=True, compact_every=1))
    return target.read()


@query("stream_two_sources", INDEX_FOLD_SQL)
def stream_two_sources(t: Tables):
    # clicks and all other events arrive in streams of their own; both fold the target after each batch
    folder = scratch(t)
    events = lambda: stream_of(t, "events").select(
        "user_id", F.col("event_id").alias("pos"), event_op().alias("op"), "event_type", "value", "props", supplied_fields().alias("supplied")
    )
    parts = {"clicks": F.col("event_type") == "click", "others": ~F.col("event_type").eqNullSafe("click")}
    target = KeyedTarget(t.spark, f"{folder}/users", ["user_id"], ["event_type", "value", "props"], "index", present="supplied")
    running = [runner.start_apply(events().filter(part), target, f"{folder}/{name}", once=True, compact_every=1) for name, part in parts.items()]
    for handle in running:
        run(handle)
    return target.read()


@query("stream_relate", """
SELECT doc_id, lang, n_chars, CASE WHEN l.doc_id IS NULL THEN '{}'
  ELSE CAST(to_json({'doc_id': l.doc_id, 'quality': l.quality, 'toxic': l.toxic}) AS VARCHAR) END AS label
FROM documents LEFT JOIN labels l USING (doc_id)""")
def stream_relate(t: Tables):
    folder = scratch(t)
    # the lookup is read anew in every micro-batch
    enrich = lambda batch: relate(batch, t.labels, [on("doc_id", "doc_id")], "11", "sub", "label", unique=True)
    docs = stream_of(t, "documents").select("doc_id", "lang", "n_chars")
    run(runner.start_append(docs, f"{folder}/docs", f"{folder}/checkpoint", enrich, once=True))
    return as_json(t.spark.read.parquet(f"{folder}/docs").drop("batch_id"), "label")


@query("stream_batches", "SELECT event_id, user_id, event_type, value FROM events")
def stream_batches(t: Tables):
    folder = scratch(t)
    rows = stream_of(t, "events").select("event_id", "user_id", "event_type", "value")
    run(runner.start_append(rows, f"{folder}/rows", f"{folder}/checkpoint", once=True))
    return t.spark.read.parquet(f"{folder}/rows").drop("batch_id")


@query("stream_from_now", """
SELECT event_id, user_id, event_type, value, 1 + event_id % 3 AS run FROM events WHERE event_id % 3 > 0""")
def stream_from_now(t: Tables):
    """A stream that passes over the files present at its start, read in two runs, each after more files came."""
    folder = scratch(t)
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    arrive = lambda part: rows.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{folder}/events")
    changes = lambda limit=None: runner.change_stream(t.spark, f"{folder}/events", rows.schema, limit)
    arrive(0)
    runner.begin_now(changes(), f"{folder}/checkpoint")
    for part in (1, 2):
        arrive(part)
        tag = lambda batch, part=part: batch.withColumn("run", F.lit(part + 1).cast("bigint"))
        run(runner.start_append(changes(4), f"{folder}/out", f"{folder}/checkpoint", tag, once=True))
    return t.spark.read.parquet(f"{folder}/out").drop("batch_id")


@query("stream_evolve", """
SELECT o_orderkey, o_custkey, CAST(o_totalprice AS VARCHAR) AS price, CAST(NULL AS VARCHAR) AS channel FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, o_custkey, CAST(o_totalprice AS VARCHAR), o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def stream_evolve(t: Tables):
    """Orders through a running stream whose structure changes between two files: a column under another name and type, one gone, one new."""
    folder, changed_at = scratch(t), 1 << 50
    first = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderstatus": "string"}
    change = {"rename": {"o_totalprice": "price"}, "retype": {"price": "string"}, "drop": ["o_orderstatus"], "add": {"channel": "string"}}

    price = F.col("o_totalprice")
    before = t.orders.where("o_orderstatus <> 'F'").withColumn("doc", F.struct("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))
    after = t.orders.where("o_orderstatus = 'F'").withColumn(
        "doc", F.struct("o_orderkey", "o_custkey", price.cast("string").alias("price"), F.col("o_orderpriority").alias("channel"))
    )
    log_line = lambda pos: F.to_json(F.struct(pos.alias("pos"), "doc")).alias("value")
    alter = t.spark.range(1).select(F.lit(json.dumps({"pos": changed_at, "alter": change})).alias("value"))
    before.select(log_line(F.col("o_orderkey"))).write.text(f"{folder}/log")
    running = structure.start_evolving(t.spark, f"{folder}/log", f"{folder}/orders", first, f"{folder}/checkpoint", interval="200 milliseconds")
    try:
        running.processAllAvailable()
        alter.write.mode("append").text(f"{folder}/log")
        after.select(log_line(F.col("o_orderkey") + changed_at)).write.mode("append").text(f"{folder}/log")
        running.processAllAvailable()
    finally:
        running.stop()
    return structure.read_current(t.spark, f"{folder}/orders", first).drop(POS)


@query("stream_queue_to_index", """
WITH log AS (
  SELECT user_id, event_id AS pos, value, event_type,
         CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'click' THEN 'update' ELSE 'insert' END AS op
  FROM events WHERE event_type <> 'purchase' OR value >= 60),
 s AS (SELECT user_id, max(pos) AS last_pos, max(pos) FILTER (op = 'delete') AS gone, max(pos) FILTER (op = 'insert') AS born FROM log GROUP BY user_id)
SELECT user_id, arg_max(value, pos) AS value, max(last_pos) AS pos FROM log JOIN s USING (user_id)
WHERE born > coalesce(gone, -1) AND pos >= born GROUP BY user_id""")
def stream_queue_to_index(t: Tables):
    """Queue messages parsed per micro-batch and applied to a document index."""
    folder = scratch(t)
    target = KeyedTarget(t.spark, f"{folder}/users", ["user_id"], ["value"], kind="index", present=PRESENT)

    def parse(batch):
        docs = parse_queue(batch, "user_id bigint, value double", "user_id", "body").docs
        return docs.withColumnsRenamed({"event_id": "pos", OP: "op"})

    events = stream_of(t, "events")
    queue = queue_messages(_Streamed(t, events)).withColumnRenamed("value", "body")
    run(runner.start_apply(queue, target, f"{folder}/checkpoint", parse, once=True))
    return target.read()


class _Streamed(Tables):
    """Tables with the events coming from a stream."""

    def __init__(self, t: Tables, events):
        super().__init__(t.spark, t.folder)
        self.events = events


@query("rebuild_target", "SELECT c_custkey, c_name, c_acctbal, CAST(-1 AS BIGINT) AS pos FROM customer")
def rebuild_target(t: Tables):
    """A target holding other rows, emptied and loaded again from the snapshot."""
    target = KeyedTarget(t.spark, f"{scratch(t)}/customers", ["c_custkey"], ["c_name", "c_acctbal"])
    stale = t.supplier.select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"),
        F.col("s_suppkey").alias("pos"), F.lit("insert").alias("op"),
    )
    target.append_batch(stale, 0)
    target.rebuild(t.customer)
    return target.read()
