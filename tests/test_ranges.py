"""Equi-depth ranges of keys."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from rillway.sources import tables
from rillway.sources.ranges import KeyRange, key_ranges


def held(df, key, ranges):
    """How many ranges hold each row, and the rows of each range."""
    conditions = [r.condition(F.col(key)) for r in ranges]
    per_row = sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0)).alias("n")
    sizes = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(conditions)]).first()
    return {r.n for r in df.select(per_row).collect()}, list(sizes)


draw = random.Random(9)
KEYS = {
    "long common prefix": ("string", [f"customer/0000000000/{i:06}" for i in range(900)]),
    "groups of prefixes": ("string", [draw.choice(["a", "ab/same-long-prefix/", "ab/same-long-prefix/", "é🙂ü/", ""]) + str(i) for i in range(900)]),
    "bytes above ASCII": ("string", ["".join(draw.choice("aé🙂ü￿\x00") for _ in range(draw.randint(0, 12))) for _ in range(900)]),
    "quotes": ("string", [f"o'{i}''" for i in range(300)]),
    "whole numbers": ("bigint", [(1 << 62) + i * i for i in range(900)] + [-(1 << 62)]),
    "decimals": ("decimal(30,5)", [decimal.Decimal(i) / 7 for i in range(500)]),
    "days": ("date", [datetime.date(2000, 1, 1) + datetime.timedelta(days=i * i % 9000) for i in range(500)]),
    "times": ("timestamp", [datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=i ** 3) for i in range(500)]),
    "doubles": ("double", [draw.gauss(0, 1e9) for _ in range(500)]),
}


@pytest.mark.parametrize("kind", list(KEYS))
def test_every_row_in_one_range_of_even_size(spark, kind):
    type_, values = KEYS[kind]
    df = spark.createDataFrame([(v,) for v in values], f"k {type_}").unionAll(spark.sql(f"SELECT CAST(NULL AS {type_}) AS k FROM range(40)"))
    if type_ == "decimal(30,5)":
        df = df.withColumn("k", F.col("k").cast(type_))
    ranges = key_ranges(df, "k", 8)
    number, sizes = held(df, "k", ranges)
    assert number == {1} and sizes == [r.rows for r in ranges] and ranges[-1].null and ranges[-1].rows == 40
    most = max(values.count(v) for v in set(values))
    assert max(sizes[:-1]) <= max(1.5 * -(-len(values) // 8), most) and len(ranges) <= 2 * 8 + 1


def test_a_frequent_key_is_a_range_of_its_own(spark):
    df = spark.createDataFrame([("hot",)] * 500 + [(f"k{i}",) for i in range(100)], "k string")
    ranges = key_ranges(df, "k", 10)
    number, sizes = held(df, "k", ranges)
    assert number == {1} and sorted(sizes)[-1] == 500 and sorted(sizes)[-2] <= 90


def test_small_tables(spark):
    none = spark.createDataFrame([], "k string")
    assert key_ranges(none, "k") == [KeyRange(None, None, 0)]
    assert key_ranges(spark.createDataFrame([(None,)], "k string"), "k") == [KeyRange(None, None, 1, True)]
    one = key_ranges(spark.createDataFrame([("x",)], "k string"), "k", 1)
    assert one == [KeyRange(None, None, 1)]
    with pytest.raises(ValueError):
        key_ranges(none, "k", 0)
    with pytest.raises(ValueError, match="no ranges"):
        key_ranges(spark.sql("SELECT array(1) AS k UNION ALL SELECT array(2) FROM range(50)"), "k", 3)


def test_predicates(spark):
    ranges = [KeyRange(None, "o'b", 1), KeyRange("o'b", 7, 1), KeyRange(datetime.date(2020, 1, 2), None, 1), KeyRange(None, None, 1, True)]
    assert tables.jdbc_predicates(ranges, "k") == ["k IS NOT NULL AND k < 'o''b'", "k >= 'o''b' AND k < 7", "k >= '2020-01-02'", "k IS NULL"]
    found = key_ranges(spark.createDataFrame([(f"n{i}",) for i in range(100)], "k string"), "k", 4)
    df = spark.createDataFrame([(f"n{i}",) for i in range(100)] + [(None,)], "k string")
    assert sum(df.filter(p).count() for p in tables.jdbc_predicates([*found, KeyRange(None, None, 1, True)], "k")) == 101
