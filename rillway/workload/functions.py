"""Queries over the script helper functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.functions import scalar
from rillway.workload.registry import Tables, query

def segment():
    return F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))


SEGMENT_SQL = "nullif(c_mktsegment, 'BUILDING')"


@query("fn_ifnull", f"""
SELECT c_custkey, CASE WHEN s IS NULL OR s = '' THEN 'none' ELSE s END AS segment, coalesce(nullif(c_acctbal, 0), -1) AS balance
FROM (SELECT *, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE {SEGMENT_SQL} END AS s FROM customer)""")
def fn_ifnull(t: Tables):
    s = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("")).otherwise(segment())
    balance = scalar.ifnull(F.nullif(F.col("c_acctbal"), F.lit(0.0)), F.lit(-1.0), text=False)
    return t.customer.select("c_custkey", scalar.ifnull(s, F.lit("none")).alias("segment"), balance.alias("balance"))


def digits():
    return F.col("p_partkey").cast("string")


@query("fn_pad_left", """
SELECT p_partkey, CASE WHEN length(x) >= 4 THEN x ELSE repeat('0', 4 - length(x)) || x END AS zeros,
       CASE WHEN length(x) >= 3 THEN x ELSE repeat('ba', 3 - length(x)) || x END AS overshoot,
       CASE WHEN length(x) >= 2 THEN CAST(length(x) AS VARCHAR) ELSE '_' || x END AS strict
FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS x FROM part)""")
def fn_pad_left(t: Tables):
    # a fill of several characters is added once per missing character, backwards on the left
    return t.part.select(
        "p_partkey", scalar.pad(digits(), "0", 4).alias("zeros"), scalar.pad(digits(), "ab", 3).alias("overshoot"),
        scalar.pad(digits(), "_", 2, strict=True).alias("strict"),
    )


@query("fn_pad_right", """
SELECT p_partkey, CASE WHEN length(x) >= 4 THEN x ELSE x || repeat('-', 4 - length(x)) END AS dashes,
       CASE WHEN length(x) >= 3 THEN x ELSE x || repeat('ab', 3 - length(x)) END AS overshoot
FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS x FROM part)""")
def fn_pad_right(t: Tables):
    return t.part.select(
        "p_partkey", scalar.pad(digits(), "-", 4, "r").alias("dashes"), scalar.pad(digits(), "ab", 3, "r").alias("overshoot")
    )


@query("fn_trim", """
SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)) AS plain,
       trim(text, 'aeE.') AS letters, ltrim(text, 'ELat') AS left_side, rtrim(text, '.e' || chr(10)) AS right_side FROM documents""")
def fn_trim(t: Tables):
    x = F.col("text")
    return t.documents.select(
        "doc_id", scalar.trim(x).alias("plain"), scalar.trim(x, "aeE.", "other").alias("letters"),
        scalar.trim(x, "ELat", "l").alias("left_side"), scalar.trim(x, ".e\n", "r").alias("right_side"),
    )


@query("fn_startwith", """
SELECT p_partkey, starts_with(p_type, 'EC') AS economy, starts_with(p_name, p_brand) AS brand_first FROM part""")
def fn_startwith(t: Tables):
    return t.part.select(
        "p_partkey", scalar.startwith(F.col("p_type"), F.lit("EC")).alias("economy"),
        scalar.startwith(F.col("p_name"), F.col("p_brand")).alias("brand_first"),
    )


@query("fn_endwith", "SELECT p_partkey, ends_with(p_name, 'ring') AS ring, ends_with(p_brand, '2') AS two FROM part")
def fn_endwith(t: Tables):
    return t.part.select(
        "p_partkey", scalar.endwith(F.col("p_name"), F.lit("ring")).alias("ring"),
        scalar.endwith(F.col("p_brand"), F.lit("2")).alias("two"),
    )


@query("fn_strtoupper", f"""
SELECT c_custkey, upper(c_name) AS name, upper({SEGMENT_SQL}) AS segment, upper(coalesce({SEGMENT_SQL}, 'null')) AS segment_js FROM customer""")
def fn_strtoupper(t: Tables):
    return t.customer.select(
        "c_custkey", scalar.strtoupper(F.col("c_name")).alias("name"), scalar.strtoupper(segment()).alias("segment"),
        scalar.strtoupper(segment(), js=True).alias("segment_js"),
    )


@query("fn_strtolower", f"SELECT c_custkey, lower(c_name) AS name, lower(coalesce({SEGMENT_SQL}, 'null')) AS segment_js FROM customer")
def fn_strtolower(t: Tables):
    return t.customer.select(
        "c_custkey", scalar.strtolower(F.col("c_name")).alias("name"), scalar.strtolower(segment(), js=True).alias("segment_js")
    )


@query("fn_strrev", "SELECT s_suppkey, reverse(s_name) AS reversed FROM supplier")
def fn_strrev(t: Tables):
    return t.supplier.select("s_suppkey", scalar.strrev(F.col("s_name")).alias("reversed"))


@query("fn_strtotime", """
SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS day_seconds,
       CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS seconds, CAST(NULL AS BIGINT) AS bad_day, CAST(NULL AS BIGINT) AS bad_length
FROM orders""")
def fn_strtotime(t: Tables):
    day, second = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t.orders.select(
        "o_orderkey", scalar.strtotime(day).alias("day_seconds"), scalar.strtotime(second).alias("seconds"),
        scalar.strtotime(F.concat(F.substring(day, 1, 4), F.lit("-13-41"))).alias("bad_day"),
        scalar.strtotime(F.concat(day, F.lit(" 10:11"))).alias("bad_length"),
    )


@query("fn_date", """
SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86461 * 1000000), '%Y-%m-%d') AS day,
       strftime(make_timestamp(o_orderkey * 86461 * 1000000), '%Y-%m-%d %H:%M:%S') AS second, CAST(NULL AS VARCHAR) AS other
FROM orders""")
def fn_date(t: Tables):
    seconds = F.col("o_orderkey") * 86461
    return t.orders.select(
        "o_orderkey", scalar.date("Y-m-d", seconds).alias("day"), scalar.date("Y-m-d H:i:s", seconds).alias("second"),
        scalar.date("d.m.Y", seconds).alias("other"),
    )


@query("fn_now")
def fn_now(t: Tables):
    return t.orders.select("o_orderkey", scalar.now().alias("seconds"))


@query("fn_now_range", "SELECT o_orderkey, true AS after_2025, true AS whole, 1 AS moments FROM orders")
def fn_now_range(t: Tables):
    """The time of the query: after 2025, not in the future, and the same in every row."""
    now = scalar.now()
    moments = t.orders.select(now.alias("s")).agg(F.count_distinct("s").cast("int")).scalar()
    return t.orders.select("o_orderkey", (now > 1735689600).alias("after_2025"), (now <= F.unix_timestamp()).alias("whole"), moments.alias("moments"))


@query("fn_ceil", "SELECT c_custkey, ceil(c_acctbal)::DOUBLE AS whole, ceil(-c_acctbal / 3)::DOUBLE AS negative FROM customer")
def fn_ceil(t: Tables):
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", scalar.ceil(x).alias("whole"), scalar.ceil(-x / 3).alias("negative"))


@query("fn_floor", "SELECT c_custkey, floor(c_acctbal)::DOUBLE AS whole, floor(-c_acctbal / 3)::DOUBLE AS negative FROM customer")
def fn_floor(t: Tables):
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", scalar.floor(x).alias("whole"), scalar.floor(-x / 3).alias("negative"))


@query("fn_round", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice)::DOUBLE AS price,
       (CASE WHEN l_quantity >= 0 THEN -floor(l_quantity / 2 + 0.5) END)::DOUBLE AS halves FROM lineitem""")
def fn_round(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", scalar.round(F.col("l_extendedprice")).alias("price"),
        scalar.round(-F.col("l_quantity") / 2).alias("halves"),
    )


@query("fn_rand")
def fn_rand(t: Tables):
    return t.orders.select("o_orderkey", scalar.rand(10, seed=1).alias("below_ten"), scalar.rand(5, 10, seed=2).alias("from_five"))


@query("fn_rand_range", "SELECT o_orderkey, true AS below_ten, true AS from_five FROM orders")
def fn_rand_range(t: Tables):
    below, five = scalar.rand(10, seed=1), scalar.rand(5, 10, seed=2)
    return t.orders.select("o_orderkey", below.between(0, 9).alias("below_ten"), five.between(5, 14).alias("from_five"))


@query("fn_abs", "SELECT c_custkey, abs(c_acctbal - 5000) AS distance, abs(c_nationkey - 12)::DOUBLE AS nations FROM customer")
def fn_abs(t: Tables):
    return t.customer.select(
        "c_custkey", scalar.abs(F.col("c_acctbal") - 5000).alias("distance"), scalar.abs(F.col("c_nationkey") - 12).alias("nations")
    )


@query("fn_max_args", "SELECT l_orderkey, l_partkey, l_linenumber, greatest(l_quantity, l_linenumber, l_suppkey)::DOUBLE AS top FROM lineitem")
def fn_max_args(t: Tables):
    top = scalar.max_args(F.col("l_quantity"), F.col("l_linenumber"), F.nullif(F.col("l_suppkey"), F.lit(-1)))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", top.alias("top"))


@query("fn_min_args", "SELECT l_orderkey, l_partkey, l_linenumber, least(l_quantity, nullif(l_linenumber, 1), l_suppkey)::DOUBLE AS low FROM lineitem")
def fn_min_args(t: Tables):
    low = scalar.min_args(F.col("l_quantity"), F.nullif(F.col("l_linenumber"), F.lit(1)), F.col("l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", low.alias("low"))


@query("fn_max_array", "SELECT vec_id, list_max(embedding)::DOUBLE AS top FROM embeddings")
def fn_max_array(t: Tables):
    return t.embeddings.select("vec_id", scalar.max_array(F.col("embedding")).alias("top"))


@query("fn_min_array", "SELECT vec_id, list_min(embedding)::DOUBLE AS low FROM embeddings")
def fn_min_array(t: Tables):
    return t.embeddings.select("vec_id", scalar.min_array(F.col("embedding")).alias("low"))


@query("fn_is_number", """
SELECT event_id, event_type <> 'view' AS k_number, true AS value_number, false AS type_number FROM events""")
def fn_is_number(t: Tables):
    # the same field as a number, or as numeric text for views
    quoted_k = F.regexp_replace("props", r"([0-9.]+)", '"$1"')
    json = F.when(F.col("event_type") == "view", quoted_k).otherwise(F.col("props"))
    return t.events.select(
        "event_id", scalar.is_number_at(json, "$.k").alias("k_number"),
        scalar.is_number(F.col("value"), t.events.schema["value"].dataType).alias("value_number"),
        scalar.is_number(F.col("event_type"), t.events.schema["event_type"].dataType).alias("type_number"),
    )
