"""Sources: messages of every shape, pages, pairs, inventory, generated rows."""

import pytest
from pyspark.sql import functions as F

from rillway.columns import ALIAS, ID_VALUE, OP, POS
from rillway.sources import changes, messages, tables


def lines(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")


def test_json_lines(spark):
    texts = ['{"a":1}', '{"a":1} x', '[{"a":1}]', '{"a":1', "null", "", "3", '{"a":1},{"a":2}', '{"b":2}', None]
    docs, errors = messages.parse_json_lines(lines(spark, texts), "a bigint")
    assert sorted((r.i, r.a) for r in docs.collect()) == [(0, 1), (8, None)]
    assert sorted(r.i for r in errors.collect()) == [1, 2, 3, 4, 5, 6, 7, 9]


def test_queue_messages(spark):
    texts = [
        '{"OptionType":"insert","data":{"id":1}}', '{"OptionType":"update","data":{"id":2,"v":null}}', '{"OptionType":"delete","data":{"id":3}}',
        '{"OptionType":"replace","data":{"id":4}}', '{"id":5,"v":"x"}', '{"OptionType":"update"}', '{"OptionType":"update","data":[1]}',
        '{"OptionType":"update","data":null}', '{"OptionType":null,"data":{"id":8}}', "{", '{"data":{"id":10}}',
    ]
    docs, errors = messages.parse_queue(lines(spark, texts), "id bigint, v string", "id")
    got = {r.i: (r[OP], r[ID_VALUE], sorted(r[messages.PRESENT])) for r in docs.collect()}
    assert got == {
        0: ("insert", "1", ["id"]), 1: ("update", "2", ["id", "v"]), 2: ("delete", "3", ["id"]), 3: ("insert", "4", ["id"]),
        4: ("insert", "5", ["id", "v"]), 8: ("insert", "8", ["id"]), 10: ("insert", "", ["data"]),
    }
    assert {r.i: r.reason for r in errors.collect()} == {
        5: "data missing", 6: "data is not an object", 7: "data is not an object", 9: "bad json",
    }


def test_index_hits(spark):
    texts = ['{"_index":"a","_id":"1","_source":{"x":1}}', '{"_index":"a","_id":"2"}', "no"]
    docs, errors = messages.parse_index_hits(lines(spark, texts), "x int")
    assert [(r.x, r[ID_VALUE]) for r in docs.collect()] == [(1, "1")] and sorted(r.i for r in errors.collect()) == [1, 2]


def test_update_pairs_drop_odd_events(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "e"), (2, 1, "f"), (2, 2, "g")]
    df = spark.createDataFrame(rows, "e int, s int, v string")
    pairs, broken = changes.pair_updates(df, "e", "s", ["v"])
    assert sorted((r.pair, r.old_doc.v, r.doc.v) for r in pairs.collect()) == [(0, "a", "b"), (1, "c", "d")]
    assert [r.e for r in broken.collect()] == [2]


def test_pages(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [r.k for r in tables.keyset_page(df, "k", None, 3).collect()] == [0, 1, 2]
    assert [r.k for r in tables.keyset_page(df, "k", 7, 5).collect()] == [8, 9]


def test_document_sets():
    assert tables.parse_document_sets("a,b") == {"a": ["a"], "b": ["b"]}
    assert tables.parse_document_sets({"a": "x", "b": ["y", "z"]}) == {"a": ["x"], "b": ["y", "z"]}
    with pytest.raises(ValueError):
        tables.parse_document_sets(3)


def test_resume(spark):
    df = spark.range(5).select(F.col("id").alias(POS))
    assert changes.resume_after(df, 2).count() == 2
    assert changes.resume_after(df, None).count() == 5


def test_inventory(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, 'x' AS name")
    rows = tables.catalog_inventory(spark, {"shop.items": df}, {"shop.items": "id"}).collect()
    assert [tuple(r) for r in rows] == [("shop", "items", "id", "int", "PRI"), ("shop", "items", "name", "string", "")]
    df.createOrReplaceTempView("inventory_view")
    df.write.option("path", str(tmp_path / "t")).saveAsTable("inventory_probe")
    found = {r.table for r in tables.catalog_inventory(spark).collect()}
    spark.sql("DROP TABLE inventory_probe")
    assert "inventory_probe" in found and "inventory_view" not in found


def test_generated_rows(spark, tmp_path):
    df = tables.generate(spark, 3)
    assert df.columns == [f"field{i}" for i in range(10)] + ["id"]
    assert [tuple(r) for r in df.select("field0", "field9", "id").collect()] == [(1, 1, "1"), (2, 2, "2"), (3, 3, "3")]
    assert tables.generate_stream(spark).isStreaming


def test_files_and_evolution(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT 1 AS a, 'x' AS b").write.json(path)
    assert tables.read_files(spark, "json", path, "a int, b string").first() == (1, "x")
    with pytest.raises(ValueError):
        tables.read_files(spark, "xls", path)
    out = tables.evolve(spark.sql("SELECT 1 AS a, 'x' AS b"), add={"c": "int"}, rename={"a": "z"}, drop=["b"])
    assert out.columns == ["z", "c"] and out.first() == (1, None)


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:x", "t", "id", (1, 100), 8, 500, user="u")
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8" and options["fetchsize"] == "500" and options["user"] == "u"
    assert "partitionColumn" not in tables.jdbc_options("jdbc:x", "t")


def test_aliases_get_their_own_copies(spark):
    df = tables.snapshot(spark.sql("SELECT 1 AS a"), "s", "a")
    assert sorted(r[ALIAS] for r in tables.fan_out_aliases(df, ["x", "y"]).collect()) == ["x", "y"]


def test_header_needs_every_field(spark):
    with pytest.raises(ValueError):
        changes.with_header(spark.range(1), {"LogPos": F.lit(1)})


def test_update_pairs_drop_events_with_a_gap(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "c"), (2, 0, "d"), (2, 1, "e")], "e int, s int, v string")
    pairs, broken = changes.pair_updates(df, "e", "s", ["v"])
    assert [(r.e, r.old_doc.v, r.doc.v) for r in pairs.collect()] == [(2, "d", "e")]
    assert [r.e for r in broken.collect()] == [1]
