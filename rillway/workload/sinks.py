"""Queries over change application, sinks, dead letters and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.columns import ALIAS, DOC_SET, ID_VALUE, OP
from rillway.operators.fold import fold_index, fold_table, outcomes, outcomes_scan, split_key_changes
from rillway.operators.keyed import delete_rows, insert_rows, update_rows
from rillway.plans.task import build_task, default_reader, run_task, target_state
from rillway.sinks import quality, writers
from rillway.sources.changes import change_ops
from rillway.workload.registry import Tables, query, scratch
from rillway.workload.sources import EVENT_OP_SQL, event_op


def event_log(t: Tables):
    return t.events.select("user_id", F.col("event_id").alias("pos"), event_op().alias("op"), "event_type", "value", "props")


EVENT_LOG_SQL = f"SELECT user_id, event_id AS pos, {EVENT_OP_SQL} AS op, event_type, value, props FROM events"


def fold_table_sql(log: str, key: str, columns: str) -> str:
    """The table fold in SQL: last delete, first insert after it, last update after that."""
    return f"""
WITH log AS ({log}),
 d AS (SELECT {key}, max(pos) AS last_pos, max(pos) FILTER (op = 'delete') AS gone FROM log GROUP BY {key}),
 i AS (SELECT {key}, min(pos) AS born FROM log JOIN d USING ({key}) WHERE op = 'insert' AND pos > coalesce(gone, -2) GROUP BY {key}),
 u AS (SELECT {key}, max(pos) AS changed FROM log JOIN i USING ({key}) WHERE op = 'update' AND pos > born GROUP BY {key})
SELECT {key}, {columns}, d.last_pos AS pos FROM i LEFT JOIN u USING ({key}) JOIN d USING ({key})
JOIN log USING ({key}) WHERE log.pos = coalesce(changed, born)"""


# ---- keyed tables

def order_rows(t: Tables):
    """Orders as rows for the customer table."""
    return t.orders.select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_name"), F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("status"),
    )


def _old_customers(t: Tables):
    return t.customer.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")


_FIRST_ORDER_SQL = """
f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY o_custkey)"""


@query("sink_insert", f"""
WITH {_FIRST_ORDER_SQL}
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT o.o_custkey, o_orderpriority, o_totalprice FROM orders o JOIN f ON o_orderkey = k""")
def sink_insert(t: Tables):
    return insert_rows(_old_customers(t), order_rows(t).drop("status"), ["c_custkey"], "pos")[0]


@query("sink_insert_refused", f"""
WITH {_FIRST_ORDER_SQL}
SELECT o_custkey AS c_custkey, o_orderkey AS pos, o_totalprice AS c_acctbal, 'duplicate key' AS reason FROM orders
WHERE o_orderkey NOT IN (SELECT k FROM f)""")
def sink_insert_refused(t: Tables):
    refused = insert_rows(_old_customers(t), order_rows(t).drop("status"), ["c_custkey"], "pos")[1]
    return refused.select("c_custkey", "pos", "c_acctbal", "reason")


@query("sink_update", """
SELECT c_custkey, coalesce(p, c_name) AS c_name, c_nationkey, coalesce(b, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p, arg_max(o_totalprice, o_orderkey) AS b
  FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def sink_update(t: Tables):
    return update_rows(t.customer, order_rows(t).drop("status"), ["c_custkey"], "pos")


@query("sink_delete", """
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def sink_delete(t: Tables):
    return delete_rows(t.customer, order_rows(t).filter("status = 'P'"), ["c_custkey"])


_MOVED_LOG = """
SELECT c_custkey, -1 AS pos, 'insert' AS op, c_acctbal FROM customer
UNION ALL SELECT o_custkey, o_orderkey, 'update', o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_custkey, o_orderkey, 'delete', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_custkey + 1000000000, o_orderkey, 'insert', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'"""


@query("sink_update_moved_key", fold_table_sql(_MOVED_LOG, "c_custkey", "c_acctbal"))
def sink_update_moved_key(t: Tables):
    base = t.customer.select("c_custkey", F.lit(-1).cast("bigint").alias("pos"), F.lit("insert").alias("op"), "c_acctbal")
    moved = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") + 1000000000).otherwise(F.col("o_custkey"))
    updates = t.orders.select(
        moved.alias("c_custkey"), F.col("o_orderkey").alias("pos"), F.lit("update").alias("op"),
        F.col("o_totalprice").alias("c_acctbal"), F.col("o_custkey").alias("old_key"),
    )
    log = base.unionByName(split_key_changes(updates, ["c_custkey"], ["old_key"]))
    return fold_table(log, ["c_custkey"], ["c_acctbal"])


# ---- change logs

@query("apply_changes_sql", fold_table_sql(EVENT_LOG_SQL, "user_id", "event_type, value, props"))
def apply_changes_sql(t: Tables):
    return fold_table(event_log(t), ["user_id"], ["event_type", "value", "props"])


_REPLICA_LOG = """
SELECT c_custkey, -1 AS pos, 'insert' AS op, c_name AS label, c_acctbal AS amount FROM customer
UNION ALL SELECT o_custkey, o_orderkey,
  CASE o_orderpriority WHEN '5-LOW' THEN 'delete' WHEN '1-URGENT' THEN 'insert' ELSE 'update' END, o_orderpriority, o_totalprice FROM orders"""


def order_changes(t: Tables):
    op = F.when(F.col("o_orderpriority") == "5-LOW", "delete").when(F.col("o_orderpriority") == "1-URGENT", "insert").otherwise("update")
    return t.orders.select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("pos"), op.alias("op"),
        F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("amount"),
    )


@query("replica", fold_table_sql(_REPLICA_LOG, "c_custkey", "label, amount").replace("d.last_pos AS pos", "CAST(c_custkey AS VARCHAR) AS id"))
def replica(t: Tables):
    """Customers as the snapshot, their orders as the changes that follow it."""
    frames = {
        "customer": lambda: t.customer.select("c_custkey", F.col("c_name").alias("label"), F.col("c_acctbal").alias("amount")),
        "order_changes": lambda: order_changes(t),
    }
    spec = {
        "resource": [{"id": "db", "type": "parquet", "path": t.folder}, {"id": "copy", "type": "empty"}],
        "source": [
            {
                "resource_id": "db", "sync_mode": "replica", "document_set": {"customer": "clients"},
                "extra": {"pk": "c_custkey", "changes": "order_changes"},
            }
        ],
        "target": [{"resource_id": "copy", "document_set": {"clients": "clients_copy"}}],
    }
    task = build_task(t.spark, spec, lambda _resource, name: frames[name]())
    state = target_state(task.outputs["copy", "clients_copy"], "table")
    return state.select("c_custkey", "label", "amount", F.col(ID_VALUE).alias("id"))


@query("sink_index_replace", """
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props,
       max(event_id) AS pos FROM events GROUP BY user_id""")
def sink_index_replace(t: Tables):
    return fold_index(event_log(t).withColumn("op", F.lit("insert")), ["user_id"], ["event_type", "value", "props"])


INDEX_FOLD_SQL = f"""
WITH log AS ({EVENT_LOG_SQL}),
 s AS (SELECT user_id, max(pos) AS last_pos, max(pos) FILTER (op = 'delete') AS gone, max(pos) FILTER (op = 'insert') AS born FROM log GROUP BY user_id),
 l AS (SELECT log.*, born, last_pos FROM log JOIN s USING (user_id) WHERE born > coalesce(gone, -1) AND pos >= born)
SELECT user_id, arg_max(event_type, pos) AS event_type,
       arg_max(value, pos) FILTER (pos = born OR event_type IN ('click', 'purchase')) AS value,
       arg_max(props, pos) FILTER (pos = born OR event_type IN ('view', 'purchase')) AS props, max(last_pos) AS pos
FROM l GROUP BY user_id"""


def supplied_fields():
    """Which fields an event's message brings along."""
    return (
        F.when(F.col("event_type") == "click", F.array(F.lit("event_type"), F.lit("value")))
        .when(F.col("event_type") == "view", F.array(F.lit("event_type"), F.lit("props")))
        .otherwise(F.array(F.lit("event_type"), F.lit("value"), F.lit("props")))
    )


@query("apply_changes_index", INDEX_FOLD_SQL)
def apply_changes_index(t: Tables):
    log = event_log(t).withColumn("supplied", supplied_fields())
    return fold_index(log, ["user_id"], ["event_type", "value", "props"], present="supplied")


# ---- sinks

@query("sink_id_choice", """
SELECT doc_id, lang, n_chars, CASE WHEN lang = 'en' THEN CAST(doc_id AS VARCHAR) WHEN lang <> 'fr' THEN 'd' || doc_id END AS _id_value FROM documents""")
def sink_id_choice(t: Tables):
    own = F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).otherwise(F.lit(""))
    body = F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    docs = t.documents.select("doc_id", "lang", "n_chars", own.alias(ID_VALUE), body.alias("_id"))
    return writers.choose_index_id(docs)


@query("sink_jsonl", """
SELECT CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'segment': nullif(c_mktsegment, 'BUILDING')}) AS VARCHAR) AS value
FROM customer WHERE c_nationkey <> 3""")
def sink_jsonl(t: Tables):
    ops = t.customer.select(
        "c_custkey", "c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_nationkey") == 3, "update").otherwise("insert").alias(OP),
    )
    return writers.object_lines(ops)[0]


@query("sink_envelope", f"""
SELECT CAST(to_json({{'OptionType': {EVENT_OP_SQL}, 'data': {{'event_id': event_id, 'user_id': user_id, 'value': value, 'props': props}}}}) AS VARCHAR) AS value FROM events""")
def sink_envelope(t: Tables):
    ops = t.events.select("event_id", "user_id", "value", "props", event_op().alias(OP))
    return writers.envelope(ops, True)


@query("sink_envelope_bare", "SELECT CAST(to_json({'event_id': event_id, 'user_id': user_id, 'value': value}) AS VARCHAR) AS value FROM events")
def sink_envelope_bare(t: Tables):
    return writers.envelope(t.events.select("event_id", "user_id", "value", event_op().alias(OP)), False)


@query("sink_noop", "SELECT count(*) AS rows FROM lineitem")
def sink_noop(t: Tables):
    counted, observation = quality.observed(t.lineitem, "discarded")
    writers.discard(counted)
    # the rows counted on the way into nothing
    return t.lineitem.groupBy().agg(F.lit(observation.get["rows"]).cast("bigint").alias("rows"))


@query("render_values", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, nullif(p_name, 'small ring') AS p_name, printf('%.6f', p_retailprice) AS p_retailprice,
       CAST(to_json([p_size, p_size * 2]) AS VARCHAR) AS sizes, CAST(to_json({'brand': p_brand, 'size': p_size}) AS VARCHAR) AS detail FROM part""")
def render_values(t: Tables):
    return writers.render_values(
        t.part.select(
            "p_partkey", F.nullif(F.col("p_name"), F.lit("small ring")).alias("p_name"), "p_retailprice",
            F.array("p_size", F.col("p_size") * 2).alias("sizes"),
            F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("detail"),
        )
    )


@query("render_values_lists", """
SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(to_json(list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::INTEGER)) AS VARCHAR) AS embedding FROM embeddings""")
def render_values_lists(t: Tables):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("int"))
    return writers.render_values(t.embeddings.select("vec_id", whole.alias("embedding")))


@query("route", """
SELECT event_id, event_type AS _alias, CASE event_type WHEN 'click' THEN 'index' WHEN 'view' THEN 'index' WHEN 'signup' THEN 'db' END AS _target,
       CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'events' WHEN 'signup' THEN 'users' END AS _target_set FROM events""")
def route(t: Tables):
    ops = t.events.select("event_id", F.col("event_type").alias(ALIAS), F.lit("events").alias(DOC_SET))
    targets = [
        {"id": "old", "document_set": {"click": "nowhere"}},
        {"id": "index", "document_set": {"click": "clicks", "view": ""}},
        {"id": "db", "document_set": {"signup": "users"}},
    ]
    return writers.route(ops, targets).drop(DOC_SET)


# ---- dead letters and metrics

_OUTCOME_SQL = f"""
WITH log AS (SELECT *, {EVENT_OP_SQL} AS op FROM events),
 b AS (SELECT *, coalesce(last_value(CASE op WHEN 'insert' THEN true WHEN 'delete' THEN false END IGNORE NULLS)
   OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS alive FROM log),
 o AS (SELECT *, CASE WHEN op = 'insert' AND alive THEN 'duplicate' WHEN op <> 'insert' AND NOT alive THEN 'no_row' ELSE 'applied' END AS outcome FROM b)"""


def event_outcomes(t: Tables):
    ops = change_ops(t.events.withColumn("op", event_op()), "events", "user_id", "event_id", "op")
    return outcomes(ops, ["user_id"], "event_id", "op")


@query("change_outcomes", _OUTCOME_SQL + "SELECT event_id, user_id, op, outcome FROM o")
def change_outcomes(t: Tables):
    return event_outcomes(t).select("event_id", "user_id", "op", "outcome")


@query("change_outcomes_scan", _OUTCOME_SQL + """, d AS (SELECT event_id, nullif(user_id, 10) AS u, op,
  coalesce(last_value(CASE op WHEN 'insert' THEN true WHEN 'delete' THEN false END IGNORE NULLS)
   OVER (PARTITION BY nullif(user_id, 10) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS alive FROM log)
SELECT event_id, u AS user_id, op, CASE WHEN op = 'insert' AND alive THEN 'duplicate' WHEN op <> 'insert' AND NOT alive THEN 'no_row' ELSE 'applied' END AS outcome FROM d""")
def change_outcomes_scan(t: Tables):
    """The same by a segmented scan in blocks of 256 and 65,536 positions; one user has lost its key."""
    log = t.events.select("event_id", F.nullif(F.col("user_id"), F.lit(10)).alias("user_id"), event_op().alias("op"))
    return outcomes_scan(log, ["user_id"], "event_id", "op", bits=8)


_LETTERS_SQL = _OUTCOME_SQL + """, letters AS (
SELECT event_id, 'delivery' AS stage, 'duplicate key' AS reason, 'events' AS alias,
       CAST(to_json({'user_id': user_id, 'event_type': event_type, 'value': value, 'props': props, 'op': op}) AS VARCHAR) AS doc_json
FROM o WHERE outcome = 'duplicate'
UNION ALL
SELECT event_id, 'pipeline', 'k is below 5', 'events',
       CAST(to_json({'user_id': user_id, 'event_type': event_type, 'value': value, 'props': props, 'op': op}) AS VARCHAR)
FROM o WHERE CAST(props->>'k' AS BIGINT) < 5)"""


def event_letters(t: Tables):
    out = event_outcomes(t).drop("ts")
    duplicates = out.filter("outcome = 'duplicate'").drop("outcome")
    low = out.filter(F.get_json_object("props", "$.k").cast("bigint") < 5).drop("outcome")
    return quality.dead_letters(duplicates, "delivery", "duplicate key", "event_id").unionByName(
        quality.dead_letters(low, "pipeline", "k is below 5", "event_id")
    )


@query("dead_letter", _LETTERS_SQL + "SELECT * FROM letters")
def dead_letter(t: Tables):
    return event_letters(t)


@query("dead_letter_tail", _LETTERS_SQL + "SELECT event_id, reason, doc_json FROM letters WHERE stage = 'delivery' ORDER BY event_id DESC LIMIT 100")
def dead_letter_tail(t: Tables):
    delivery = event_letters(t).filter("stage = 'delivery'")
    return quality.latest_letters(delivery, "event_id", 100).select("event_id", "reason", "doc_json")


@query("task_metrics", _OUTCOME_SQL + """
SELECT count(*) AS full_read_count, count(*) - count(*) FILTER (k < 5) - count(*) FILTER (k >= 5 AND outcome = 'duplicate') AS full_delivery_count,
       count(*) FILTER (k >= 5 AND outcome = 'duplicate') AS failed_delivery_count, count(*) FILTER (k < 5) AS failed_pipeline_count,
       CAST(count(*) // max(CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 1704067200) AS VARCHAR) || '/s' AS rate
FROM (SELECT *, CAST(props->>'k' AS BIGINT) AS k FROM o)""")
def task_metrics(t: Tables):
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = event_outcomes(t)
    seconds = (F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))) - 1704067200).alias("seconds")
    metrics = quality.run_metrics(out, k < 5, (k >= 5) & (F.col("outcome") == "duplicate"), extra=[seconds])
    return metrics.withColumn("rate", quality.rows_per_second(F.col("full_read_count"), F.col("seconds"))).drop("seconds")


@query("task_health", _OUTCOME_SQL + """
SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN dayofweek(any_value(ts)) = 0 THEN 'red' WHEN dayofweek(any_value(ts)) = 6 THEN 'none'
  WHEN count(*) FILTER (outcome = 'duplicate') > 0 THEN 'yellow' ELSE 'green' END AS health FROM o GROUP BY 1""")
def task_health(t: Tables):
    failed = F.count_if(F.col("outcome") == "duplicate")
    days = event_outcomes(t).groupBy(F.to_date("ts").alias("d")).agg(failed.alias("failures"))
    # the task is stopped on Sundays and done on Saturdays
    state = F.when(F.dayofweek("d") == 1, "stop").when(F.dayofweek("d") == 7, "done").otherwise("run")
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), quality.health(state, F.col("failures")).alias("health"))


_TASK_LOG = """
WITH log AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
  CASE WHEN event_type = 'view' AND value < 50 THEN 'NaN'::DOUBLE ELSE value END AS value FROM events)"""


def _watched_spec(folder: str) -> dict:
    """Events as a change log into object lines, which take inserts only; views below 50 fail on the way, small ones are filtered."""
    flow = [
        {"type": "map", "set": {"value": "if(event_type = 'view' AND value < 50, double('NaN'), value)"}, "check_numbers": True},
        {"type": "filter", "where": "value < 10"},
        {"type": "map", "drop": ["props", "event_type"]},
    ]
    return {
        "setup": {"error_record": True},
        "resource": [{"id": "in", "type": "parquet", "path": folder}, {"id": "out", "type": "lines", "path": folder}],
        "source": [{"resource_id": "in", "sync_mode": "stream", "document_set": {"events": "users"}, "extra": {"pk": "user_id", "pos": "event_id"}}],
        "target": [{"resource_id": "out", "document_set": {"users": "lines"}}],
        "pipeline": [{"document_set": "users", "flow": flow}],
    }


def _watched_run(t: Tables):
    folder = scratch(t)
    log = lambda: t.events.select("user_id", "event_id", event_op().alias("op"), "event_type", "value", "props")
    spec = _watched_spec(folder)
    return folder, run_task(t.spark, spec, folder, lambda _resource, _name: log())


@query("task_run_metrics", _TASK_LOG + """
SELECT 'users' AS alias, count(*) AS full_read_count, count(*) FILTER (NOT isnan(value) AND (op = 'insert' OR value < 10)) AS full_delivery_count,
       count(*) FILTER (NOT isnan(value) AND value >= 10 AND op <> 'insert') AS failed_delivery_count, count(*) FILTER (isnan(value)) AS failed_pipeline_count
FROM log""")
def task_run_metrics(t: Tables):
    """The counts of a task, taken by the jobs that wrote its output and its dead letters."""
    return _watched_run(t)[1]


@query("task_dead_letters", _TASK_LOG + """
SELECT 'pipeline' AS stage, 'users' AS alias, count(*) AS letters FROM log WHERE isnan(value)
UNION ALL SELECT 'delivery', 'users', count(*) FROM log WHERE NOT isnan(value) AND value >= 10 AND op <> 'insert'""")
def task_dead_letters(t: Tables):
    """What a batch task left in its folder for the rows it could not deliver."""
    folder, _ = _watched_run(t)
    letters = t.spark.read.parquet(f"{folder}/errors")
    return letters.groupBy("stage", "alias").agg(F.count(F.lit(1)).alias("letters"))


@query("task_fan_out", """
SELECT 'orders' AS target, o_orderkey, o_totalprice, CAST(NULL AS DECIMAL(18, 2)) AS price FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'mirror', o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'prices', o_orderkey, NULL, o_totalprice FROM orders""".replace("CAST(NULL AS DECIMAL(18, 2))", "CAST(NULL AS DOUBLE)"))
def task_fan_out(t: Tables):
    """One scan and one job for two copies of the open orders, one more scan for the prices, all to sets of one folder."""
    folder = scratch(t)
    price = [{"srcField": a, "srcType": k, "aimField": b, "aimType": k} for a, b, k in (("o_orderkey", "o_orderkey", "long"), ("o_totalprice", "price", "float"))]
    spec = {
        "resource": [
            {"id": "in", "type": "parquet", "path": t.folder, "suffix": ".parquet"}, {"id": "out", "type": "parquet", "path": f"{folder}/out", "partitioned": True},
        ],
        "source": [{"resource_id": "in", "sync_mode": "direct", "document_set": {"orders": ["open", "again", "prices"]}, "extra": {"pk": "o_orderkey"}}],
        "target": [{"resource_id": "out", "document_set": {"orders": "", "again": "mirror", "prices": "prices"}}],
        "pipeline": [
            {"document_set": "open,again", "flow": [{"type": "filter", "where": "o_orderstatus = 'F'"}]},
            {"document_set": "prices", "flow": [{"type": "mapInline", "field_map": price}]},
        ],
    }
    run_task(t.spark, spec, folder)
    return t.spark.read.parquet(f"{folder}/out").select("target", "o_orderkey", "o_totalprice", "price")


@query("index_copy", """
SELECT 'people' AS index_name, 'c' || c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer WHERE c_acctbal >= 0""")
def index_copy(t: Tables):
    """Hits of one index copied to another under their own ids."""
    folder = scratch(t)
    body = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    hits = lambda: t.customer.select(F.to_json(F.struct(F.lit("clients").alias("_index"), F.concat(F.lit("c"), "c_custkey").alias("_id"), body.alias("_source"))).alias("value"))
    spec = {
        "resource": [{"id": "in", "type": "index", "path": folder}, {"id": "out", "type": "index", "path": f"{folder}/out"}],
        "source": [{"resource_id": "in", "sync_mode": "direct", "document_set": "clients", "extra": {"schema": "name string, nation int, balance double"}}],
        "target": [{"resource_id": "out", "document_set": {"clients": "people"}}],
        "pipeline": [{"document_set": "clients", "flow": [{"type": "filter", "where": "balance < 0"}, {"type": "map", "drop": ["balance"]}]}],
    }
    run_task(t.spark, spec, folder, lambda _resource, _name: hits())
    hit = F.from_json("value", "_index string, _id string, _source struct<name: string, nation: int>").alias("hit")
    copied = t.spark.read.text(f"{folder}/out/people").select(hit)
    return copied.select(F.col("hit._index").alias("index_name"), F.col("hit._id").alias("id"), F.col("hit._source.name").alias("name"), F.col("hit._source.nation").alias("nation"))


# ---- the whole way

def sync_spec(folder: str) -> dict:
    """Customers, enriched with their nation, to an index."""
    rename = lambda source, target, kind: {"srcField": source, "srcType": kind, "aimField": target, "aimType": kind}
    return {
        "setup": {"desc": "customers to the index"},
        "resource": [
            {"id": "files", "type": "parquet", "path": folder, "suffix": ".parquet"},
            {"id": "index", "type": "empty"},
        ],
        "source": [
            {"resource_id": "files", "sync_mode": "direct", "document_set": {"customer": "clients"}, "extra": {"pk": "c_custkey"}},
            {"resource_id": "files", "sync_mode": "empty", "document_set": ""},
        ],
        "target": [{"resource_id": "index", "document_set": {"clients": "clients_live"}}],
        "pipeline": [
            {
                "document_set": "clients",
                "flow": [
                    {"type": "map", "set": {"batch_no": "7"}},
                    {"type": "filter", "where": "c_acctbal > 5000"},
                    {
                        "type": "mapInline",
                        "field_map": [rename("c_custkey", "client_no", "long"), rename("c_name", "client_name", "string"), rename("c_acctbal", "balance", "string")],
                    },
                    {
                        "type": "relateInline", "assoc_type": "11", "relate_resource_id": "files", "relate_document_set": "nation",
                        "layer_type": "sib",
                        "field_map": {
                            "s.client_no": "client_no", "s.client_name": "client_name", "s.balance": "balance", "s.batch_no": "batch_no",
                            "r.n_name": "nation|s:unknown", "r.n_regionkey": "region",
                        },
                        "wheres": [{"src_field": "c_nationkey", "operator": "=", "rel_field": "n_nationkey"}],
                    },
                ],
            }
        ],
    }


@query("task_end_to_end", """
SELECT c_custkey AS client_no, c_name AS client_name, printf('%.6f', c_acctbal) AS balance, 7 AS batch_no, coalesce(n_name, 'unknown') AS nation,
       n_regionkey AS region, CAST(c_custkey AS VARCHAR) AS _id_value, 'clients' AS _alias
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE NOT (c_acctbal > 5000)""")
def task_end_to_end(t: Tables):
    task = build_task(t.spark, sync_spec(t.folder), default_reader(t.spark))
    out = task.outputs["index", "clients_live"]
    return out.select("client_no", "client_name", "balance", "batch_no", "nation", "region", ID_VALUE, ALIAS)
