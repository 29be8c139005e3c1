"""Queries over the in-row steps: map, filter, mapInline and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.columns import ID_FIELD, ID_VALUE, OP, quoted
from rillway.functions.coerce import coerce_column
from rillway.functions.script import js_number, js_string
from rillway.operators.steps import filter_step, map_inline, map_step, merge_columns, merge_maps
from rillway.plans.flow import run_flow
from rillway.sources.changes import change_ops
from rillway.sources.tables import snapshot
from rillway.workload.registry import Tables, query
from rillway.workload.sources import EVENT_OP_SQL, event_op


def _rule(source: str, target: str, source_type: str, target_type: str) -> dict:
    return {"srcField": source, "srcType": source_type, "aimField": target, "aimType": target_type}


@query("map_add_column", """
SELECT *, 7 AS batch_no, c_acctbal * 2 AS twice, upper(c_name) AS loud FROM customer""")
def map_add_column(t: Tables):
    return map_step(t.customer, {"batch_no": "7", "twice": "c_acctbal * 2", "loud": "upper(c_name)"})


@query("map_drop_column", "SELECT c_custkey, c_name, c_acctbal / 4 AS c_acctbal FROM customer")
def map_drop_column(t: Tables):
    return map_step(t.customer, {"c_acctbal": "c_acctbal / 4"}, drop=["c_nationkey", "c_mktsegment"])


@query("map_by_op_type", f"""
SELECT event_id, value, CASE WHEN {EVENT_OP_SQL} = 'delete' THEN 0.0 ELSE value END AS kept,
       'users:' || {EVENT_OP_SQL} AS origin FROM events""")
def map_by_op_type(t: Tables):
    ops = change_ops(t.events, "users", "user_id", "event_id", event_op())
    out = map_step(ops, {"kept": f"if({OP} = 'delete', 0.0D, value)", "origin": f"concat(_alias, ':', {OP})"})
    return out.select("event_id", "value", "kept", "origin")


@query("map_rekey", """
SELECT c_custkey, c_name, 'c_name' AS _id_field, c_name AS _id_value FROM customer""")
def map_rekey(t: Tables):
    out = map_step(snapshot(t.customer, "customer", "c_custkey"), rekey="c_name")
    return out.select("c_custkey", "c_name", ID_FIELD, ID_VALUE)


@query("filter_drop", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderstatus = 'O')""")
def filter_drop(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return filter_step(orders, "o_totalprice > 100000 AND o_orderstatus = 'O'")


@query("filter_null_keeps", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL OR o_orderstatus <> 'O'""")
def filter_null_keeps(t: Tables):
    return filter_step(t.orders.select("o_orderkey", "o_orderstatus"), "nullif(o_orderstatus, 'F') = 'O'")


@query("filter_truthy", """
SELECT c_custkey, c_nationkey, c_mktsegment FROM customer
WHERE c_nationkey = 0 OR nullif(c_mktsegment, 'BUILDING') IS NULL""")
def filter_truthy(t: Tables):
    customer = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    # a number is true unless 0, a text unless empty, null is false
    kept_zero = filter_step(customer.filter("c_mktsegment <> 'BUILDING'"), "c_nationkey")
    kept_empty = filter_step(customer.filter("c_mktsegment = 'BUILDING'"), "nullif(c_mktsegment, 'BUILDING')")
    return kept_zero.unionByName(kept_empty)


@query("map_inline_rename", """
SELECT c_custkey AS id, c_name AS client_name, c_nationkey, printf('%.6f', c_acctbal) AS balance, c_mktsegment FROM customer""")
def map_inline_rename(t: Tables):
    return map_inline(
        t.customer,
        [
            _rule("c_custkey", "id", "long", "long"), _rule("c_name", "client_name", "string", "string"),
            _rule("c_acctbal", "balance", "float", "string"), _rule("absent", "nothing", "long", "long"),
            _rule("c_nationkey", "ignored", "long", ""),
        ],
    )


@query("map_inline_swap", """
SELECT CAST(0 AS BIGINT) AS s_suppkey, s_nationkey, s_acctbal, CAST(s_suppkey AS VARCHAR) AS s_name FROM supplier""")
def map_inline_swap(t: Tables):
    # the name is no number, so it becomes the key 0
    return map_inline(t.supplier, [_rule("s_suppkey", "s_name", "long", "string"), _rule("s_name", "s_suppkey", "string", "long")])


# part texts of every kind: whole, decimal, blank-padded, signed, too large, empty, plain words
_TEXT = """
CASE p_size % 8 WHEN 0 THEN cast(p_partkey AS string) WHEN 1 THEN concat(cast(p_partkey AS string), '.5')
 WHEN 2 THEN concat(' ', cast(p_partkey AS string), ' ') WHEN 3 THEN concat('-', cast(p_partkey AS string))
 WHEN 4 THEN concat('99999999999999999999', cast(p_partkey AS string)) WHEN 5 THEN '' WHEN 6 THEN p_name
 ELSE concat('-99999999999999999999', cast(p_partkey AS string)) END"""
_TEXT_SQL = """
CASE p_size % 8 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_partkey || '.5' WHEN 2 THEN ' ' || p_partkey || ' '
 WHEN 3 THEN '-' || p_partkey WHEN 4 THEN '99999999999999999999' || p_partkey WHEN 5 THEN '' WHEN 6 THEN p_name
 ELSE '-99999999999999999999' || p_partkey END"""
_LONG_SQL = """
CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN coalesce(try_cast(x AS BIGINT),
  CASE WHEN x LIKE '-%' THEN -9223372036854775808 ELSE 9223372036854775807 END) ELSE 0 END"""
_FLOAT_SQL = """
CASE WHEN regexp_full_match(x, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(x AS DOUBLE) ELSE 0.0 END"""


def _texts(t: Tables):
    return t.part.select("p_partkey", "p_retailprice", "p_size", F.expr(_TEXT).alias("x"))


@query("coerce_long", f"""
SELECT p_partkey, CAST({_LONG_SQL} AS BIGINT) AS from_text, trunc(p_retailprice * -0.37)::BIGINT AS from_double,
       p_size::BIGINT AS from_int, CAST(0 AS BIGINT) AS from_null FROM (SELECT *, {_TEXT_SQL} AS x FROM part)""")
def coerce_long(t: Tables):
    df = _texts(t)
    df = df.withColumns({"d": F.col("p_retailprice") * -0.37, "n": F.nullif(F.col("p_size"), F.col("p_size"))})
    cast = lambda c: coerce_column(quoted(c), df.schema[c].dataType, "long")
    return df.select(
        "p_partkey", cast("x").alias("from_text"), cast("d").alias("from_double"), cast("p_size").alias("from_int"),
        cast("n").alias("from_null"),
    )


@query("coerce_float", f"""
SELECT p_partkey, {_FLOAT_SQL} AS from_text, p_size::DOUBLE AS from_int, p_retailprice AS from_double,
       0.0::DOUBLE AS from_bool FROM (SELECT *, {_TEXT_SQL} AS x FROM part)""")
def coerce_float(t: Tables):
    df = _texts(t)
    df = df.withColumn("b", F.col("p_size") > 10)
    cast = lambda c: coerce_column(quoted(c), df.schema[c].dataType, "float")
    return df.select(
        "p_partkey", cast("x").alias("from_text"), cast("p_size").alias("from_int"), cast("p_retailprice").alias("from_double"),
        cast("b").alias("from_bool"),
    )


@query("coerce_string", """
SELECT p_partkey, printf('%.6f', p_retailprice) AS from_double, p_size::VARCHAR AS from_int,
       CASE WHEN p_size > 10 THEN 'true' ELSE 'false' END AS from_bool, coalesce(nullif(p_brand, 'Brand#2'), '') AS from_text,
       CAST(to_json([p_size, p_size + 1]) AS VARCHAR) AS from_list FROM part""")
def coerce_string(t: Tables):
    df = t.part.withColumns(
        {
            "b": F.col("p_size") > 10, "n": F.nullif(F.col("p_brand"), F.lit("Brand#2")),
            "l": F.array(F.col("p_size"), F.col("p_size") + 1),
        }
    )
    cast = lambda c: coerce_column(quoted(c), df.schema[c].dataType, "string")
    return df.select(
        "p_partkey", cast("p_retailprice").alias("from_double"), cast("p_size").alias("from_int"), cast("b").alias("from_bool"),
        cast("n").alias("from_text"), cast("l").alias("from_list"),
    )


@query("coerce_two_stage", f"""
SELECT p_partkey, CAST(CAST({_LONG_SQL} AS BIGINT) AS VARCHAR) AS x_long, trunc(p_retailprice / 7)::BIGINT::DOUBLE AS price
FROM (SELECT *, {_TEXT_SQL} AS x FROM part)""")
def coerce_two_stage(t: Tables):
    df = _texts(t).withColumn("p_retailprice", F.col("p_retailprice") / 7).drop("p_size")
    return map_inline(df, [_rule("x", "x_long", "long", "string"), _rule("p_retailprice", "price", "long", "float")])


@query("script_text_and_number", """
SELECT c_custkey, CASE WHEN c_acctbal = trunc(c_acctbal) THEN CAST(c_acctbal::BIGINT AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END AS balance_text,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'null') AS segment_text, c_custkey + 0.5::DOUBLE AS key_number
FROM customer""")
def script_text_and_number(t: Tables):
    df = t.customer.withColumns(
        {"s": F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), "k": F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".5\n"))}
    )
    return df.select(
        "c_custkey", js_string(F.col("c_acctbal"), df.schema["c_acctbal"].dataType).alias("balance_text"),
        js_string(F.col("s"), df.schema["s"].dataType).alias("segment_text"), js_number(F.col("k"), df.schema["k"].dataType).alias("key_number"),
    )


@query("flow_chain", """
SELECT o_orderkey AS id, o_custkey, o_orderstatus, printf('%.6f', o_totalprice) AS total, 7 AS batch_no, c.c_name AS customer_name
FROM orders LEFT JOIN customer c ON c_custkey = o_custkey WHERE NOT (o_totalprice > 200000)""")
def flow_chain(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    steps = [
        {"type": "map", "set": {"batch_no": "7"}},
        {"type": "filter", "where": "o_totalprice > 200000"},
        {"type": "mapInline", "field_map": [_rule("o_orderkey", "id", "long", "long"), _rule("o_totalprice", "total", "float", "string")]},
        {
            "type": "relateInline", "assoc_type": "11", "relate_document_set": "customer", "layer_type": "sib", "unique": True,
            "field_map": {
                "s.id": "id", "s.o_custkey": "o_custkey", "s.o_orderstatus": "o_orderstatus", "s.total": "total", "s.batch_no": "batch_no",
                "r.c_name": "customer_name",
            },
            "wheres": [{"src_field": "o_custkey", "operator": "=", "rel_field": "c_custkey"}],
        },
    ]
    return run_flow(orders, steps, lambda _resource, name: getattr(t, name))[0]


@query("doc_merge", """
SELECT c_custkey, c_name, nullif(n_name, 'NATION_3') AS label, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def doc_merge(t: Tables):
    nation = t.nation.select("n_nationkey", F.nullif(F.col("n_name"), F.lit("NATION_3")).alias("r_label"), "n_regionkey")
    both = t.customer.withColumn("label", F.col("c_mktsegment")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    # the later document wins, nulls included
    merged = merge_columns(["c_custkey", "c_name", "label"], {"label": F.col("r_label"), "n_regionkey": F.col("n_regionkey")})
    return both.select(*merged)


@query("doc_merge_maps", """
SELECT c_custkey, c_name AS a, CAST(NULL AS VARCHAR) AS b, c_mktsegment AS c FROM customer""")
def doc_merge_maps(t: Tables):
    first = F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("b"), F.col("c_name"))
    second = F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.col("c_mktsegment"))
    merged = t.customer.select("c_custkey", merge_maps(first, second).alias("m"))
    return merged.select("c_custkey", *[F.col("m")[k].alias(k) for k in "abc"])
