"""Queries over the lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.operators.relate import find, relate
from rillway.plans.flow import run_flow
from rillway.workload.registry import Tables, query


def on(source: str, rel: str, const=None) -> dict:
    return {"src_field": source, "operator": "=", "rel_field": rel, "const_value": const}


def as_json(df, name: str):
    """The nested column as JSON text; an array is put in order of its texts' fields already."""
    return df.withColumn(name, F.to_json(name))


def slim_orders(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def slim_lines(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("relate_11_first", """
SELECT c_custkey, c_name, o.o_orderkey AS first_order, o.o_totalprice AS first_price FROM customer
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice
           FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def relate_11_first(t: Tables):
    fields = {"s.c_custkey": "c_custkey", "s.c_name": "c_name", "r.o_orderkey": "first_order", "r.o_totalprice": "first_price"}
    return relate(t.customer, t.orders, [on("c_custkey", "o_custkey")], "11", "sib", field_map=fields, order_by=["o_orderkey"])


@query("relate_11_sub", """
SELECT doc_id, lang, n_chars, CASE WHEN l.doc_id IS NULL THEN '{}'
  ELSE CAST(to_json({'doc_id': l.doc_id, 'quality': l.quality, 'toxic': l.toxic}) AS VARCHAR) END AS label
FROM documents LEFT JOIN labels l USING (doc_id)""")
def relate_11_sub(t: Tables):
    docs = t.documents.select("doc_id", "lang", "n_chars")
    return as_json(relate(docs, t.labels, [on("doc_id", "doc_id")], "11", "sub", "label"), "label")


@query("relate_11_sib_merge", """
SELECT doc_id, coalesce(l.quality, d.quality) AS quality, lang, toxic
FROM (SELECT doc_id, CAST(n_chars AS INTEGER) AS quality, lang FROM documents) d LEFT JOIN labels l USING (doc_id)""")
def relate_11_sib_merge(t: Tables):
    docs = t.documents.select("doc_id", F.col("n_chars").cast("int").alias("quality"), "lang")
    return relate(docs, t.labels, [on("doc_id", "doc_id")], "11", "sib", unique=True)


@query("relate_11_sib_merge_null_wins", """
SELECT c_custkey, nullif(n_name, 'NATION_3') AS c_name, n_nationkey, n_regionkey
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def relate_11_sib_merge_null_wins(t: Tables):
    nation = t.nation.select("n_nationkey", F.nullif(F.col("n_name"), F.lit("NATION_3")).alias("c_name"), "n_regionkey")
    out = relate(t.customer, nation, [on("c_nationkey", "n_nationkey")], "11", "sib")
    return out.select("c_custkey", "c_name", "n_nationkey", "n_regionkey")


@query("relate_11_sib_map", """
SELECT c_custkey AS id, c_name AS name, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def relate_11_sib_map(t: Tables):
    fields = {"s.c_custkey": "id", "c_name": "name", "r.n_name": "nation", "a.b.c": "ignored"}
    return relate(t.customer, t.nation, [on("c_nationkey", "n_nationkey")], "11", "sib", field_map=fields)


@query("relate_defaults", """
SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality, coalesce(CAST(toxic AS VARCHAR), 'unknown') AS toxic,
       coalesce(nullif(lang, 'fr'), 'xx') AS lang, 7::BIGINT AS absent, 1.5::DOUBLE AS rate
FROM documents LEFT JOIN labels USING (doc_id)""")
def relate_defaults(t: Tables):
    docs = t.documents.select("doc_id", F.nullif(F.col("lang"), F.lit("fr")).alias("lang"))
    fields = {
        "s.doc_id": "doc_id", "s.lang": "lang|s:xx", "r.quality": "quality|i:-1", "r.toxic": "toxic|str:unknown",
        "r.nothing": "absent|i:7", "r.rate": "rate|f:1.5",
    }
    out = relate(docs, t.labels.withColumn("rate", F.lit(None).cast("double")), [on("doc_id", "doc_id")], "11", "sib", field_map=fields)
    return out.withColumn("quality", F.col("quality").cast("bigint"))


@query("relate_11_sib_empty_map", "SELECT doc_id, lang, n_chars FROM documents")
def relate_11_sib_empty_map(t: Tables):
    docs = t.documents.select("doc_id", "lang", "n_chars")
    return relate(docs, t.labels, [on("doc_id", "doc_id")], "11", "sib", field_map={})


@query("relate_1n_sub", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(to_json(l.lines) AS VARCHAR) AS lines FROM orders LEFT JOIN (
  SELECT l_orderkey, list({'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_quantity': l_quantity}
    ORDER BY l_linenumber, l_partkey, l_quantity) AS lines FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def relate_1n_sub(t: Tables):
    return as_json(relate(slim_orders(t), slim_lines(t), [on("o_orderkey", "l_orderkey")], "1n", "sub", "lines"), "lines")


@query("relate_1n_sib_map", """
SELECT CASE WHEN l_orderkey IS NULL THEN o_custkey END AS o_custkey, CASE WHEN l_orderkey IS NULL THEN o_orderstatus END AS o_orderstatus,
       CASE WHEN l_orderkey IS NULL THEN o_totalprice END AS o_totalprice, o_orderkey, l_linenumber AS line, l_quantity AS quantity
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def relate_1n_sib_map(t: Tables):
    fields = {"s.o_orderkey": "o_orderkey", "r.l_linenumber": "line", "r.l_quantity": "quantity"}
    return relate(slim_orders(t), t.lineitem, [on("o_orderkey", "l_orderkey")], "1n", "sib", field_map=fields, split_hot=True)


@query("relate_1n_drop", """
SELECT o_orderkey, l_linenumber AS line, l_quantity AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def relate_1n_drop(t: Tables):
    fields = {"s.o_orderkey": "o_orderkey", "r.l_linenumber": "line", "r.l_quantity": "quantity"}
    return relate(t.orders, t.lineitem, [on("o_orderkey", "l_orderkey")], "1n", "sib", field_map=fields, unmatched="drop")


@query("relate_1n_sib_merge", """
SELECT n_nationkey, n_name, n_regionkey, s_suppkey, s_name, s_nationkey, s_acctbal FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def relate_1n_sib_merge(t: Tables):
    return relate(t.nation, t.supplier, [on("n_nationkey", "s_nationkey")], "1n", "sib")


@query("relate_1n_sib_empty_map", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def relate_1n_sib_empty_map(t: Tables):
    return relate(slim_orders(t), t.lineitem, [on("o_orderkey", "l_orderkey")], "1n", "sib", field_map={})


@query("relate_multi_key", """
SELECT a.conv_id, a.turn, a.role, a.text, b.role AS next_role, b.text AS next_text
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def relate_multi_key(t: Tables):
    main = t.conversations.withColumn("next_turn", F.col("turn") + 1)
    fields = {
        "s.conv_id": "conv_id", "s.turn": "turn", "s.role": "role", "s.text": "text", "r.role": "next_role", "r.text": "next_text",
    }
    wheres = [on("conv_id", "conv_id"), on("next_turn", "turn")]
    return relate(main, t.conversations, wheres, "11", "sib", field_map=fields, unique=True)


@query("relate_const", """
SELECT c_custkey, c_name, o.k AS order_key FROM customer LEFT JOIN (
  SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def relate_const(t: Tables):
    # a constant counts only where the document lacks the field, as with "status" here
    wheres = [on("c_custkey", "o_custkey"), on("status", "o_orderstatus", "F")]
    fields = {"s.c_custkey": "c_custkey", "s.c_name": "c_name", "r.o_orderkey": "order_key"}
    return relate(t.customer, t.orders, wheres, "11", "sib", field_map=fields, order_by=["o_orderkey"])


@query("relate_const_only", """
SELECT c_custkey, c_name, o_orderkey AS order_key, o_totalprice AS price FROM customer
LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1) ON true""")
def relate_const_only(t: Tables):
    # nothing of the document is compared, so all get the same row
    fields = {"s.c_custkey": "c_custkey", "s.c_name": "c_name", "r.o_orderkey": "order_key", "r.o_totalprice": "price"}
    return relate(t.customer, t.orders, [on("status", "o_orderstatus", "P")], "11", "sib", field_map=fields, order_by=["o_orderkey"])


@query("relate_const_only_all", """
SELECT s_suppkey, s_name, n_name AS nation, n_regionkey AS region FROM supplier JOIN nation ON n_regionkey = 3""")
def relate_const_only_all(t: Tables):
    fields = {"s.s_suppkey": "s_suppkey", "s.s_name": "s_name", "r.n_name": "nation", "r.n_regionkey": "region"}
    return relate(t.supplier, t.nation, [on("region", "n_regionkey", 3)], "1n", "sib", field_map=fields, unmatched="drop")


@query("relate_wide_decimal", """
SELECT c_custkey, c_acctbal, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 2 = 0""")
def relate_wide_decimal(t: Tables):
    """Whole numbers against decimals of 30 fraction digits; the odd orders have a fraction and match nobody."""
    fraction = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("." + "0" * 29 + "1")
    key = F.concat(F.col("o_custkey").cast("string"), fraction).try_cast("decimal(38, 30)")
    orders = t.orders.select("o_orderkey", key.alias("cust"))
    main = t.customer.select("c_custkey", "c_acctbal")
    return relate(main, orders, [on("c_custkey", "cust")], "1n", "sib").drop("cust")


@query("relate_1n_hot_both", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 3 ELSE c_nationkey END AS place FROM customer),
 s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 3 WHEN s_suppkey % 11 > 0 THEN s_nationkey END AS place FROM supplier)
SELECT c_custkey, c.place, s_suppkey FROM c LEFT JOIN s ON c.place = s.place""")
def relate_1n_hot_both(t: Tables):
    """Half of the customers and half of the suppliers share one place, many have none."""
    number = lambda name: F.col(name) % 2 == 0
    main = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, None).when(number("c_custkey"), 3).otherwise(F.col("c_nationkey")).alias("place"))
    lookup = t.supplier.select("s_suppkey", F.when(number("s_suppkey"), 3).when(F.col("s_suppkey") % 11 > 0, F.col("s_nationkey")).alias("at"))
    out = relate(main, lookup, [on("place", "at")], "1n", "sib", split_hot=20)
    return out.select("c_custkey", "place", "s_suppkey")


@query("relate_missing_field", """
SELECT c_custkey, o.k AS order_key FROM customer LEFT JOIN (
  SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def relate_missing_field(t: Tables):
    wheres = [on("c_custkey", "o_custkey"), on("no_such_field", "o_orderstatus"), on("c_name", "o_orderpriority")]
    fields = {"s.c_custkey": "c_custkey", "r.o_orderkey": "order_key"}
    return relate(t.customer, t.orders, wheres, "11", "sib", field_map=fields, order_by=["o_orderkey"], on_missing="truncate")


@query("relate_no_condition_left", "SELECT c_custkey, c_name, CAST(NULL AS BIGINT) AS order_key FROM customer")
def relate_no_condition_left(t: Tables):
    fields = {"s.c_custkey": "c_custkey", "s.c_name": "c_name", "r.o_orderkey": "order_key"}
    return relate(t.customer, t.orders, [on("no_such_field", "o_custkey")], "11", "sib", field_map=fields, on_missing="truncate")


@query("relate_null_key", """
SELECT o_orderkey, nullif(o_custkey, 10) AS cust, c_name FROM orders LEFT JOIN customer ON c_custkey = nullif(o_custkey, 10)""")
def relate_null_key(t: Tables):
    orders = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey"), F.lit(10)).alias("cust"))
    fields = {"s.o_orderkey": "o_orderkey", "s.cust": "cust", "r.c_name": "c_name"}
    return relate(orders, t.customer, [on("cust", "c_custkey")], "11", "sib", field_map=fields, unique=True, split_hot=True)


@query("relate_text_key", """
SELECT s_suppkey, nation_text, n_name FROM (SELECT s_suppkey, lower(n_name) AS nation_text FROM supplier JOIN nation ON n_nationkey = s_nationkey)
LEFT JOIN nation ON lower(n_name) = nation_text""")
def relate_text_key(t: Tables):
    # text against a number compares as numbers, text keys may ignore case
    supplier = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation_key"))
    named = relate(
        supplier, t.nation, [on("nation_key", "n_nationkey")], "11", "sib", unique=True,
        field_map={"s.s_suppkey": "s_suppkey", "r.n_name": "nation_text"},
    ).withColumn("nation_text", F.lower("nation_text"))
    fields = {"s.s_suppkey": "s_suppkey", "s.nation_text": "nation_text", "r.n_name": "n_name"}
    return relate(named, t.nation, [on("nation_text", "n_name")], "11", "sib", field_map=fields, unique=True, keys_ci=True)


@query("document_find", """
SELECT doc_id, lang, CASE WHEN l.doc_id IS NOT NULL THEN CAST(to_json({'doc_id': l.doc_id, 'quality': l.quality, 'toxic': l.toxic}) AS VARCHAR) END AS label
FROM documents LEFT JOIN labels l USING (doc_id)""")
def document_find(t: Tables):
    found = find(t.documents.select("doc_id", "lang"), t.labels, "label", [on("doc_id", "doc_id")], unique=True)
    return as_json(found, "label")


@query("relate_chain", """
SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus, c_name, n_name FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def relate_chain(t: Tables):
    keep = {c: c for c in ("l_orderkey", "l_linenumber", "l_quantity")}
    first = relate(
        t.lineitem, t.orders, [on("l_orderkey", "o_orderkey")], "11", "sib", unique=True, split_hot=True,
        field_map={**keep, "r.o_custkey": "o_custkey", "r.o_orderstatus": "o_orderstatus"},
    )
    second = relate(
        first, t.customer, [on("o_custkey", "c_custkey")], "11", "sib", unique=True, split_hot=True,
        field_map={**keep, "o_orderstatus": "o_orderstatus", "r.c_name": "c_name", "r.c_nationkey": "c_nationkey"},
    )
    return relate(
        second, t.nation, [on("c_nationkey", "n_nationkey")], "11", "sib", unique=True,
        field_map={**keep, "o_orderstatus": "o_orderstatus", "c_name": "c_name", "r.n_name": "n_name"},
    )


_SIBLINGS = """
WITH f AS (SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'),
 j AS (SELECT f.*, l_partkey, l_orderkey IS NOT NULL AS hit FROM f LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'),
 a AS (SELECT *, bool_or(hit) OVER (PARTITION BY c_custkey) AS any_hit FROM j)
SELECT c_custkey, c_name, o_orderkey, l_partkey FROM a WHERE hit OR NOT any_hit"""


@query("relate_1n_siblings", _SIBLINGS)
def relate_1n_siblings(t: Tables):
    """A second 1:n after a first: unmatched rows stay only if no row of the same customer matched."""
    steps = [
        {
            "type": "relateInline", "assoc_type": "1n", "relate_document_set": "orders", "layer_type": "sib", "unmatched": "nulls",
            "field_map": {"s.c_custkey": "c_custkey", "s.c_name": "c_name", "r.o_orderkey": "o_orderkey"},
            "wheres": [on("c_custkey", "o_custkey"), on("status", "o_orderstatus", "P")],
        },
        {
            "type": "relateInline", "assoc_type": "1n", "relate_document_set": "lineitem", "layer_type": "sib", "unmatched": "nulls",
            "field_map": {"s.c_custkey": "c_custkey", "s.c_name": "c_name", "s.o_orderkey": "o_orderkey", "r.l_partkey": "l_partkey"},
            "wheres": [on("o_orderkey", "l_orderkey"), on("flag", "l_returnflag", "R")],
        },
    ]
    return run_flow(t.customer, steps, lambda _resource, name: getattr(t, name), root=["c_custkey"])[0]


@query("relate_1n_cut", """
WITH n AS (SELECT s_suppkey, count(l_suppkey) AS k FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey),
 p AS (SELECT *, greatest(1, (k + 99) // 100) AS parts FROM n)
SELECT s_suppkey, part, parts, CASE WHEN k > 0 THEN least(100, k - 100 * part) END AS size
FROM (SELECT *, unnest(range(parts)) AS part FROM p)""")
def relate_1n_cut(t: Tables):
    """The line items of each supplier nested, a hundred to a row at most, and what each row holds."""
    items = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    nested = relate(t.supplier.select("s_suppkey"), items, [on("s_suppkey", "l_suppkey")], "1n", "sub", "items", array_rows=100)
    size = F.when(F.col("items").isNotNull(), F.size("items")).cast("bigint")
    return nested.select("s_suppkey", F.col("items_part").alias("part"), F.col("items_parts").alias("parts"), size.alias("size"))
