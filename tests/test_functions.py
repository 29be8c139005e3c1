"""Script helper functions on edge values."""

from pyspark.sql import functions as F

from rillway.functions import scalar
from rillway.sources.changes import decode_bit, decode_enum, decode_float, decode_set


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_pad(spark):
    lit = F.lit
    assert one(spark, scalar.pad(lit("7"), "0", 3)) == "007"
    assert one(spark, scalar.pad(lit("7"), "ab", 3)) == "baba7"
    assert one(spark, scalar.pad(lit("7"), "ab", 3, "r")) == "7abab"
    assert one(spark, scalar.pad(lit("long"), "0", 3)) == "long"
    assert one(spark, scalar.pad(lit("long"), "0", 3, strict=True)) == "4"
    assert one(spark, scalar.pad(lit(None), "0", 6, js=True)) == "00null"
    assert one(spark, scalar.pad(lit(None).cast("string"), "0", 6)) is None


def test_trim(spark):
    assert one(spark, scalar.trim(F.lit(" \t\n\r\x00\x0b a b \x00"))) == "a b"
    assert one(spark, scalar.trim(F.lit("xxaxx"), "x", "l")) == "axx"
    assert one(spark, scalar.trim(F.lit("xxaxx"), "x", "r")) == "xxa"
    assert one(spark, scalar.trim(F.lit("xxaxx"), "x", "q")) == "a"
    assert one(spark, scalar.trim(F.lit(" a "), "")) == " a "
    assert one(spark, scalar.trim(F.lit(None).cast("string"))) is None


def test_times(spark):
    assert one(spark, scalar.strtotime(F.lit("2024-03-01"))) == 1709251200
    assert one(spark, scalar.strtotime(F.lit("2024-03-01 00:00:05"))) == 1709251205
    for bad in ("2024-02-30", "2024-3-01", "2024/03/01", "2024-03-01T00:00:05", ""):
        assert one(spark, scalar.strtotime(F.lit(bad))) is None
    assert one(spark, scalar.date("Y-m-d H:i:s", F.lit(1709251205))) == "2024-03-01 00:00:05"
    assert one(spark, scalar.date("Y", F.lit(0))) is None


def test_numbers(spark):
    assert [one(spark, scalar.round(F.lit(x))) for x in (2.5, -2.5, 0.4)] == [3.0, -3.0, 0.0]
    assert [one(spark, scalar.ceil(F.lit(x))) for x in (1.2, -1.2, 1e300)] == [2.0, -1.0, 1e300]
    assert one(spark, scalar.floor(F.lit(-1.2))) == -2.0
    assert one(spark, F.isnan(scalar.floor(F.lit(float("nan")))))
    assert [str(one(spark, f(F.lit(-0.3)))) for f in (scalar.ceil, scalar.round)] == ["-0.0", "-0.0"]
    assert one(spark, scalar.abs(F.lit(-3))) == 3.0
    assert one(spark, scalar.max_args(F.lit(1), F.lit(None).cast("int"), F.lit(float("nan")))) == 1.0
    assert one(spark, scalar.max_args(F.lit(1))) is None
    assert one(spark, scalar.min_array(F.array(F.lit(2.0), F.lit(None), F.lit(float("nan"))))) == 2.0
    assert one(spark, scalar.max_array(F.array().cast("array<double>"))) is None


def test_is_number(spark):
    for json, expected in (('{"k":1}', True), ('{"k":1.5e3}', True), ('{"k":"1"}', False), ('{"k":null}', False), ("{}", False), ("x", False)):
        assert one(spark, scalar.is_number_at(F.lit(json), "$.k")) is expected


def test_ifnull_and_case(spark):
    assert one(spark, scalar.ifnull(F.lit(""), F.lit("d"))) == "d"
    assert one(spark, scalar.ifnull(F.lit(0), F.lit(5), text=False)) == 0
    assert one(spark, scalar.strtoupper(F.lit("éa"))) == "ÉA"
    assert one(spark, scalar.strtolower(F.lit(None), js=True)) == "null"
    assert one(spark, scalar.strrev(F.lit("a😀b"))) == "b😀a"
    assert one(spark, scalar.startwith(F.lit("null!"), F.lit(None), js=True)) is True


def test_numeric_names(spark):
    schema = spark.sql("SELECT 1 a, 'x' b, 2.5D c").schema
    assert scalar.numeric_names(schema, ["a", "b", "c"]) == ["a", "c"]


def test_decoding(spark):
    labels = ["x", "y"]
    assert [one(spark, decode_enum(F.lit(i), labels)) for i in (1, 2, 0, 3, -1)] == ["x", "y", "", "", ""]
    assert one(spark, decode_enum(F.lit(None).cast("int"), labels)) is None
    assert [one(spark, decode_set(F.lit(i), labels)) for i in (0, 1, 3, 4)] == ["", "x", "x,y", ""]
    assert [one(spark, decode_bit(F.lit(v))) for v in ("\x01", "\x00", "a")] == ["1", "0", "0"]
    cases = {1.0: "1", 123456.7: "123457", 1234567.0: "1.23457e+06", 0.0001: "0.0001", 0.00001: "1e-05", -2.5: "-2.5", 1e200: "1e+200"}
    assert {v: one(spark, decode_float(F.lit(v))) for v in cases} == cases
