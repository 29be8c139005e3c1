"""Queries over the sources: snapshots, pages, messages and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.columns import ALIAS, DOC_SET, ID_FIELD, ID_VALUE, OP, POS
from rillway.sources import changes, logs, messages, ranges, tables
from rillway.workload.registry import Tables, query

# events as a change log: the operation of each event type
def event_op():
    return F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")


EVENT_OP_SQL = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END"


def day_text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


@query("snapshot_scan", """
SELECT *, 'insert' AS _op_type, 'customer' AS _doc_set, 'c_custkey' AS _id_field,
       CAST(c_custkey AS VARCHAR) AS _id_value FROM customer""")
def snapshot_scan(t: Tables):
    df = tables.snapshot(t.customer, "customer", "c_custkey")
    return df.select(*t.customer.columns, OP, DOC_SET, ID_FIELD, ID_VALUE)


@query("snapshot_scan_no_pk", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate,
       'insert' AS _op_type, '' AS _id_value FROM lineitem""")
def snapshot_scan_no_pk(t: Tables):
    df = tables.snapshot(t.lineitem, "lineitem").withColumn("l_shipdate", day_text("l_shipdate"))
    return df.select(*t.lineitem.columns, OP, ID_VALUE)


@query("keyset_page", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500""")
def keyset_page(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return tables.keyset_page(orders, "o_orderkey", after=1000, size=500)


@query("keyset_ranges", """
SELECT o_orderkey, nullif(o_orderpriority || '/' || o_orderkey, '1-URGENT/' || o_orderkey) AS name, 1 AS holders, true AS even FROM orders""")
def keyset_ranges(t: Tables):
    """Orders under a text key in ten ranges: how many hold each row, and whether its range is near a tenth of the rows. The
    rows of one priority have no key and are a range of their own."""
    name = F.when(F.col("o_orderpriority") != "1-URGENT", F.concat_ws("/", "o_orderpriority", F.col("o_orderkey").cast("string")))
    rows = t.orders.select("o_orderkey", name.alias("name"))
    found = ranges.key_ranges(rows, "name", 10)
    keyed = sum(r.rows for r in found if not r.null)
    inside = [r.condition(F.col("name")) for r in found]
    holders = sum((F.when(c, 1).otherwise(0) for c in inside), F.lit(0))
    even = F.coalesce(*[F.when(c, F.lit(r.null or r.rows <= 1.5 * -(-keyed // 10))) for c, r in zip(inside, found)])
    return rows.select("o_orderkey", "name", holders.alias("holders"), even.alias("even"))


@query("change_stream", f"""
SELECT event_id, user_id, event_type, value, props, {EVENT_OP_SQL} AS _op_type, alias AS _alias,
       CAST(user_id AS VARCHAR) AS _id_value, event_id AS _pos
FROM events, (VALUES ('users'), ('users_copy')) a(alias)""")
def change_stream(t: Tables):
    ops = changes.change_ops(t.events.drop("ts"), "events", "user_id", "event_id", event_op(), ["users", "users_copy"])
    return ops.select("event_id", "user_id", "event_type", "value", "props", OP, ALIAS, ID_VALUE, POS)


# six rows per log event, alternating old and new; events that start with an error lost their last row
_PAIR_ROWS = """
WITH r AS (
  SELECT event_id // 6 AS log_event, event_id % 6 AS seq, user_id, value, event_type FROM events
), b AS (
  SELECT * FROM r
  WHERE NOT (seq = 5 AND log_event IN (SELECT log_event FROM r WHERE seq = 0 AND event_type = 'error'))
)"""


def _pair_rows(t: Tables):
    rows = t.events.select(
        F.floor(F.col("event_id") / 6).alias("log_event"), (F.col("event_id") % 6).alias("seq"),
        "user_id", "value", "event_type",
    )
    lost = rows.filter((F.col("seq") == 0) & (F.col("event_type") == "error")).select("log_event", F.lit(5).cast("bigint").alias("seq"))
    return rows.join(lost, ["log_event", "seq"], "left_anti")


@query("change_pairs", _PAIR_ROWS + """
SELECT log_event, seq // 2 AS pair,
       max(user_id) FILTER (seq % 2 = 0) AS old_user, max(user_id) FILTER (seq % 2 = 1) AS new_user,
       max(value) FILTER (seq % 2 = 0) AS old_value, max(value) FILTER (seq % 2 = 1) AS new_value
FROM b WHERE log_event NOT IN (SELECT log_event FROM b GROUP BY log_event HAVING count(*) % 2 = 1)
GROUP BY log_event, seq // 2""")
def change_pairs(t: Tables):
    pairs, _broken = changes.pair_updates(_pair_rows(t), "log_event", "seq", ["user_id", "value"])
    return pairs.select(
        "log_event", "pair", F.col("old_doc.user_id").alias("old_user"), F.col("doc.user_id").alias("new_user"),
        F.col("old_doc.value").alias("old_value"), F.col("doc.value").alias("new_value"),
    )


@query("change_pairs_broken", _PAIR_ROWS + """
SELECT log_event FROM b GROUP BY log_event HAVING count(*) % 2 = 1""")
def change_pairs_broken(t: Tables):
    return changes.pair_updates(_pair_rows(t), "log_event", "seq", ["user_id", "value"])[1]


@query("change_deletes", """
SELECT event_id, 'delete' AS op_type, user_id AS doc_user, value AS doc_value, user_id AS old_user
FROM events WHERE event_type = 'error'
UNION ALL
SELECT event_id, CASE event_type WHEN 'signup' THEN 'insert' ELSE 'update' END, user_id, -value, user_id
FROM events WHERE event_type <> 'error'""")
def change_deletes(t: Tables):
    rows = t.events.select(
        "event_id", event_op().alias("op_type"),
        F.struct("user_id", (-F.col("value")).alias("value")).alias("doc"), F.struct("user_id", "value").alias("old_doc"),
    )
    out = changes.delete_images(rows, op="op_type")
    return out.select(
        "event_id", "op_type", F.col("doc.user_id").alias("doc_user"), F.col("doc.value").alias("doc_value"),
        F.col("old_doc.user_id").alias("old_user"),
    )


@query("change_header", f"""
SELECT event_id, {EVENT_OP_SQL} AS op_type,
       CAST(to_json({{'Timestamp': CAST(epoch(date_trunc('second', ts)) AS BIGINT), 'EventType': event_type, 'ServerID': 1,
                'EventSize': length(props), 'LogPos': event_id, 'Flags': 0}}) AS VARCHAR) AS header,
       CASE WHEN {EVENT_OP_SQL} = 'update' THEN CAST(to_json({{'user_id': user_id, 'value': value}}) AS VARCHAR) END AS old_doc
FROM events""")
def change_header(t: Tables):
    fields = {
        "Timestamp": F.unix_timestamp(F.col("ts").cast("timestamp")), "EventType": F.col("event_type"), "ServerID": F.lit(1),
        "EventSize": F.length("props"), "LogPos": F.col("event_id"), "Flags": F.lit(0),
    }
    df = t.events.withColumn("op_type", event_op())
    out = changes.with_header(df, fields, F.struct("user_id", "value"), op="op_type")
    return out.select("event_id", "op_type", F.to_json(changes.HEADER).alias("header"), F.to_json(changes.OLD_DOC).alias("old_doc"))


@query("resume_from_pos", """
SELECT event_id, user_id, event_type, value FROM events
WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'signup' AND value < 50 AND ts < TIMESTAMP '2024-01-15 00:00:00')""")
def resume_from_pos(t: Tables):
    # the saved position is the last one the target has seen
    applied = t.events.filter("event_type = 'signup' AND value < 50 AND ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    saved = applied.agg(F.max("event_id")).scalar()
    return changes.resume_after(t.events, saved, "event_id").select("event_id", "user_id", "event_type", "value")


# events as a log in files of a hundred changes, 40 bytes apart after a head of 4
def _file_log(t: Tables):
    file = F.concat(F.lit("log."), F.lpad(F.expr("event_id div 100").cast("string"), 6, "0"))
    return t.events.select("event_id", "user_id", file.alias("file"), (F.lit(4) + F.col("event_id") % 100 * 40).alias("offset"))


@query("resume_from_manifest", """
SELECT 'held' AS kind, event_id, user_id FROM events WHERE event_id > 324
UNION ALL SELECT 'purged', event_id, user_id FROM events WHERE event_id >= 800
UNION ALL SELECT 'short', event_id, user_id FROM events WHERE event_id > 311
UNION ALL SELECT 'short, all', event_id, user_id FROM events""")
def resume_from_manifest(t: Tables):
    """The same saved position against three lists of files: one that holds it, one whose old files are gone, and one in
    which its file ends too early. From a lost position the log is followed from where the list ended."""
    log, saved = _file_log(t), logs.Position("log.000003", 990)
    listed = logs.manifest_of(log)
    short = logs.manifest_of(log.filter("event_id < 312"))
    kinds = {
        "held": logs.resume(log, listed, saved),
        "purged": logs.resume(log, listed.filter("file between 'log.000005' and 'log.000007'"), saved),
        "short": logs.resume(log, short, saved),
        "short, all": logs.resume(log, short, saved, lost="start"),
    }
    return tables.multi_source(kinds).select(F.col(DOC_SET).alias("kind"), "event_id", "user_id")


def _cut(text, broken):
    """The JSON text, without its last character where it should be broken."""
    return F.when(broken, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


@query("index_scan", """
SELECT text, lang, n_chars, 'insert' AS _op_type, source AS _doc_set, CAST(doc_id AS VARCHAR) AS _id_value
FROM documents WHERE n_chars >= 200""")
def index_scan(t: Tables):
    hit = F.to_json(
        F.struct(
            F.col("source").alias("_index"), F.col("doc_id").cast("string").alias("_id"),
            F.struct("text", "lang", "n_chars").alias("_source"),
        )
    )
    dump = t.documents.select(_cut(hit, F.col("n_chars") < 200).alias("value"))
    docs = messages.parse_index_hits(dump, "text string, lang string, n_chars bigint").docs
    return docs.select("text", "lang", "n_chars", OP, DOC_SET, ID_VALUE)


@query("index_scan_errors", """
SELECT doc_id, 'bad hit' AS reason FROM documents WHERE n_chars < 200""")
def index_scan_errors(t: Tables):
    hit = F.to_json(F.struct(F.col("source").alias("_index"), F.struct("text", "lang").alias("_source")))
    dump = t.documents.select("doc_id", _cut(hit, F.col("n_chars") < 200).alias("value"))
    return messages.parse_index_hits(dump, "text string, lang string").errors.select("doc_id", "reason")


def queue_messages(t: Tables):
    """Events as queue messages of every kind: envelopes, bare objects and broken ones."""
    doc = F.struct("user_id", "value")
    kind, value = F.col("event_type"), F.col("value")
    wrap = lambda op: F.to_json(F.struct(F.lit(op).alias("OptionType"), doc.alias("data")))
    text = (
        F.when(kind == "signup", wrap("insert")).when(kind == "error", wrap("delete")).when(kind == "click", wrap("update"))
        .when(kind == "view", F.to_json(doc))
        .when(value < 20, F.substring(wrap("update"), F.lit(1), F.length(wrap("update")) - 1))
        .when(value < 40, F.lit('{"OptionType":"update"}'))
        .when(value < 60, F.lit('{"OptionType":"update","data":"text"}'))
        .otherwise(wrap("upsert"))
    )
    return t.events.select("event_id", text.alias("value"))


@query("queue_parse", """
SELECT event_id, user_id, value, CAST(user_id AS VARCHAR) AS _id_value,
       CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'update' ELSE 'insert' END AS _op_type
FROM events WHERE event_type <> 'purchase' OR value >= 60""")
def queue_parse(t: Tables):
    docs = messages.parse_queue(queue_messages(t).withColumnRenamed("value", "body"), "user_id bigint, value double", "user_id", "body").docs
    return docs.select("event_id", "user_id", "value", ID_VALUE, OP)


@query("queue_parse_errors", """
SELECT event_id, CASE WHEN value < 20 THEN 'bad json' WHEN value < 40 THEN 'data missing' ELSE 'data is not an object' END AS reason
FROM events WHERE event_type = 'purchase' AND value < 60""")
def queue_parse_errors(t: Tables):
    return messages.parse_queue(queue_messages(t), "user_id bigint, value double").errors.select("event_id", "reason")


@query("jsonl_scan", """
SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE event_type <> 'error'""")
def jsonl_scan(t: Tables):
    lines = t.events.select("event_id", _cut(F.col("props"), F.col("event_type") == "error").alias("value"))
    return messages.parse_json_lines(lines, "k bigint").docs


@query("jsonl_scan_errors", """
SELECT event_id, 'not a json object' AS reason, props[1:length(props) - 1] AS body FROM events WHERE event_type = 'error'""")
def jsonl_scan_errors(t: Tables):
    lines = t.events.select("event_id", _cut(F.col("props"), F.col("event_type") == "error").alias("value"))
    return messages.parse_json_lines(lines, "k bigint").errors


@query("schema_evolve", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total, CAST(NULL AS VARCHAR) AS channel FROM orders WHERE o_orderstatus <> 'F'
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def schema_evolve(t: Tables):
    orders = t.orders.drop("o_orderdate")
    before = orders.filter("o_orderstatus <> 'F'")
    after = orders.filter("o_orderstatus = 'F'").withColumnsRenamed({"o_totalprice": "total", "o_orderpriority": "channel"})
    changed = tables.evolve(before, add={"channel": "string"}, rename={"o_totalprice": "total"}, drop=["o_orderpriority"])
    return changed.unionByName(after)


@query("decode_enum", """
SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 5 THEN ['tiny', 'small', 'medium', 'large', 'huge'][p_size] ELSE '' END AS label
FROM part""")
def decode_enum(t: Tables):
    labels = ["tiny", "small", "medium", "large", "huge"]
    return t.part.select("p_partkey", changes.decode_enum(F.col("p_size"), labels).alias("label"))


@query("decode_set", """
SELECT p_partkey, array_to_string(list_filter(
  [CASE WHEN p_size & (1 << i) > 0 THEN ['a', 'b', 'c', 'd', 'e', 'f'][i + 1] END FOR i IN range(6)], lambda x: x IS NOT NULL), ',') AS labels
FROM part""")
def decode_set(t: Tables):
    return t.part.select("p_partkey", changes.decode_set(F.col("p_size"), list("abcdef")).alias("labels"))


@query("decode_bit", """
SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL WHEN p_size < 25 THEN '1' ELSE '0' END AS flag FROM part""")
def decode_bit(t: Tables):
    raw = F.when(F.col("p_size") < 25, F.lit("\x01")).otherwise(F.lit("\x00"))
    return t.part.select("p_partkey", changes.decode_bit(F.when(F.col("p_size") != 7, raw)).alias("flag"))


@query("decode_float", """
SELECT p_partkey, printf('%.6g', p_retailprice) AS price, printf('%.6g', p_retailprice * 1024.0) AS large,
       printf('%.6g', p_retailprice / 134217728.0) AS small FROM part""")
def decode_float(t: Tables):
    price = F.col("p_retailprice")
    return t.part.select(
        "p_partkey", changes.decode_float(price).alias("price"), changes.decode_float(price * 1024.0).alias("large"),
        changes.decode_float(price / 134217728.0).alias("small"),
    )


@query("stringify", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, nullif(p_brand, 'Brand#2') AS p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
       printf('%.6f', p_retailprice) AS p_retailprice FROM part""")
def stringify(t: Tables):
    return tables.stringify(t.part.withColumn("p_brand", F.nullif(F.col("p_brand"), F.lit("Brand#2"))))


@query("multi_source", """
SELECT n_name, NULL AS r_name, 'nation' AS _doc_set, 'places' AS _alias FROM nation
UNION ALL SELECT NULL, r_name, 'region', 'region' FROM region""")
def multi_source(t: Tables):
    frames = {"nation": t.nation, "region": t.region}
    return tables.multi_source(frames, {"nation": ["places"]}).select("n_name", "r_name", DOC_SET, ALIAS)


@query("alias_fanout", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, alias AS _alias FROM supplier, (VALUES ('r1'), ('r2')) a(alias)""")
def alias_fanout(t: Tables):
    return tables.fan_out_aliases(t.supplier, ["r1", "r2"])
