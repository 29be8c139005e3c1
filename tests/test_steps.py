"""In-row steps and coercions on edge values."""

import math

import pytest
from pyspark.sql import functions as F

from rillway.columns import ERROR, ID_FIELD, ID_VALUE
from rillway.functions.coerce import coerce_column, six_decimals
from rillway.functions.script import js_number, js_string, truthy
from rillway.operators.steps import SpecError, filter_step, map_inline, map_step, merge_maps, split_errors
from rillway.plans.flow import check_steps, run_flow


def values(spark, items, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    t = df.schema["v"].dataType
    return [r.o for r in df.select("i", fn(F.col("v"), t).alias("o")).orderBy("i").collect()]


def rule(source, target, a="string", b="string"):
    return {"srcField": source, "srcType": a, "aimField": target, "aimType": b}


def test_text_to_long(spark):
    texts = ["12", "+12", "-7", "12.5", " 7 ", "", None, "12\n", "9223372036854775808", "-9223372036854775809", "0x1f", "1e3"]
    got = values(spark, texts, "string", lambda c, t: coerce_column(c, t, "long"))
    assert got == [12, 12, -7, 0, 0, 0, 0, 0, 2**63 - 1, -(2**63), 0, 0]


def test_double_to_long(spark):
    got = values(spark, [2.9, -2.9, None, 1e30, float("nan")], "double", lambda c, t: coerce_column(c, t, "long"))
    assert got == [2, -2, 0, 0, 0]
    assert values(spark, [True, None], "boolean", lambda c, t: coerce_column(c, t, "long")) == [0, 0]
    assert values(spark, [[1], None], "array<int>", lambda c, t: coerce_column(c, t, "long")) == [0, 0]


def test_text_to_float(spark):
    texts = ["1.5", ".5", "5.", "-1e3", "1.5d", " 1", "", None, "1e999", "-inf", "Infinity", "1_0"]
    got = values(spark, texts, "string", lambda c, t: coerce_column(c, t, "float"))
    assert got == [1.5, 0.5, 5.0, -1000.0, 0.0, 0.0, 0.0, 0.0, float("inf"), float("-inf"), float("inf"), 0.0]
    assert math.isnan(values(spark, ["NaN"], "string", lambda c, t: coerce_column(c, t, "float"))[0])


def test_to_string(spark):
    got = values(spark, [2022.0, 0.1, None, float("inf"), float("nan")], "double", lambda c, t: coerce_column(c, t, "string"))
    assert got == ["2022.000000", "0.100000", "", "+Inf", "NaN"]
    assert values(spark, [7, None], "int", lambda c, t: coerce_column(c, t, "string")) == ["7", ""]
    assert values(spark, [True], "boolean", lambda c, t: coerce_column(c, t, "string")) == ["true"]
    assert values(spark, [[1, None]], "array<int>", lambda c, t: coerce_column(c, t, "string")) == ["[1,null]"]


def test_two_stage(spark):
    assert values(spark, ["12.5", "12"], "string", lambda c, t: coerce_column(c, t, "long", "string")) == ["0", "12"]
    with pytest.raises(ValueError):
        values(spark, ["1"], "string", lambda c, t: coerce_column(c, t, "date"))


def test_six_decimals_keep_null(spark):
    assert values(spark, [1.25, None], "double", lambda c, t: F.when(c.isNotNull(), six_decimals(c))) == ["1.250000", None]


def test_script_text(spark):
    doubles = [100.0, 1e7, 12345678.9, 0.1, -2.5, 1e21, 1.5e-7, 0.00001, 0.0, None, float("nan"), 123456789012345680.0]
    got = values(spark, doubles, "double", js_string)
    assert got == [
        "100", "10000000", "12345678.9", "0.1", "-2.5", "1e+21", "1.5e-7", "0.00001", "0", "null", "NaN", "123456789012345680",
    ]
    assert values(spark, ["a", None], "string", js_string) == ["a", "null"]


def test_script_number(spark):
    got = values(spark, [" 12 ", "", None, "abc", "1e2", "0x1F", "-Infinity", "1d"], "string", js_number)
    assert [None if math.isnan(x) else x for x in got] == [12.0, 0.0, 0.0, None, 100.0, 31.0, float("-inf"), None]


def test_truth(spark):
    assert values(spark, ["", "0", None], "string", truthy) == [False, True, False]
    assert values(spark, [0.0, float("nan"), -1.0, None], "double", truthy) == [False, False, True, False]
    assert values(spark, [0, 3], "int", truthy) == [False, True]
    assert values(spark, [[], None], "array<int>", truthy) == [True, False]


def test_filter_drops_true_and_keeps_null(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, p boolean")
    assert [r.i for r in filter_step(df, "p").orderBy("i").collect()] == [2, 3]
    assert filter_step(df, "array(i)").count() == 3


def test_map_expressions_see_the_input(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert map_step(df, {"a": "b", "b": "a"}).first() == (2, 1)
    out = map_step(df, rekey="b", drop=["a"]).first()
    assert out[ID_FIELD] == "b" and out[ID_VALUE] == "2" and "a" not in out
    with pytest.raises(SpecError):
        map_step(df, rekey="zz")


def test_map_by_a_function_over_batches(spark):
    def double(batches):
        for b in batches:
            yield b.assign(a=b.a * 2)

    df = spark.createDataFrame([(1, "x"), (2, "y")], "a bigint, b string")
    out = map_step(df, fn=lambda d: d.mapInPandas(double, d.schema))
    assert sorted(tuple(r) for r in out.collect()) == [(2, "x"), (4, "y")]


def test_map_inline_rules(spark):
    df = spark.createDataFrame([(1, "x", 2.5)], "a int, b string, c double")
    swapped = map_inline(df, [rule("a", "b"), rule("b", "a")])
    assert swapped.columns == ["a", "b", "c"] and swapped.first() == ("x", "1", 2.5)
    assert map_inline(df, [rule("a", "z"), rule("a", "y")]).columns == ["b", "c", "y"]
    assert map_inline(df, [rule("c", "c", "long", "long")]).first().c == 2
    assert map_inline(df, [rule("no", "z"), rule("a", "", "long", "long")]).columns == ["a", "b", "c"]
    for bad in ([rule("a", "z"), rule("b", "z")], [rule("a", "z", "date")], [rule("", "z")]):
        with pytest.raises(SpecError):
            map_inline(df, bad)


def test_map_merge(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) m, map('b', CAST(NULL AS INT), 'c', 3) n")
    assert df.select(merge_maps(F.col("m"), F.col("n"))).first()[0] == {"a": 1, "b": None, "c": 3}


def test_bad_numbers_lose_the_row(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 2.0)], "i int, d double")
    steps = [
        {"type": "map", "set": {"r": "try_divide(1D, d)"}},
        {"type": "map", "set": {"r": "CASE WHEN d = 0 THEN double('Infinity') ELSE 1 / d END"}, "check_numbers": True},
        {"type": "filter", "where": "i > 0 AND d = 0"},
    ]
    good, failed = run_flow(df, steps, None)
    assert [tuple(r) for r in good.collect()] == [(2, 2.0, 0.5)]
    assert [(r.i, r[ERROR]) for r in failed.collect()] == [(1, "map: r is not a finite number")]


def test_failed_row_takes_its_root_along(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "bad"), (2, 3, None)], f"r int, i int, {ERROR} string")
    good, failed = split_errors(df, ["r"])
    assert [r.i for r in good.collect()] == [3] and [r.r for r in failed.collect()] == [1]


@pytest.mark.parametrize("steps", [
    [], [{"type": "sort"}], [{"type": "map"}], [{"type": "filter"}], [{"type": "mapInline", "field_map": []}],
    [{"type": "mapInline", "field_map": [rule("a", "b", "date")]}],
    [{"type": "relateInline", "assoc_type": "n1"}],
    [{"type": "relateInline", "assoc_type": "11", "relate_document_set": "x", "layer_type": "sub", "wheres": [{}]}],
    [{"type": "relateInline", "assoc_type": "11", "relate_document_set": "x", "layer_type": "sib", "wheres": [{}]}],
    [{"type": "relateInline", "assoc_type": "11", "relate_document_set": "x", "layer_type": "sub", "sub_label": "y", "wheres": []}],
])
def test_bad_steps_are_refused(steps):
    with pytest.raises(SpecError):
        check_steps(steps)


def test_no_python_functions_in_plans(spark):
    df = spark.createDataFrame([("1", 2.5)], "s string, d double")
    out = filter_step(map_inline(map_step(df, {"t": "upper(s)"}), [rule("s", "n", "long", "long"), rule("d", "e", "float", "string")]), "n > 5")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
