"""Lookup joins on rows that sit on the edges."""

import pytest
from pyspark.sql import functions as F

from rillway.operators.relate import const_text, find, parse_field_map, relate, resolve_conditions
from rillway.operators.skew import _grid, cut_groups, find_hot_keys, grid_join, salted_join
from rillway.operators.steps import SpecError
from rillway.plans.flow import run_flow


def on(source, rel, const=None):
    return {"src_field": source, "operator": "=", "rel_field": rel, "const_value": const}


@pytest.fixture(scope="module")
def main(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "id int, name string")


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [(1, "x", 10), (1, "y", 5), (2, None, 7), (9, "z", 1), (None, "n", 2)]
    return spark.createDataFrame(rows, "id int, name string, rank int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_match_by_order(main, lookup):
    out = relate(main, lookup, [on("id", "id")], "11", "sib", field_map={"s.name": "m", "r.name": "l"}, order_by=["rank"])
    assert rows(out) == sorted([("a", "y"), ("b", None), ("c", None), ("d", None)], key=repr)


def test_nested_match_is_empty_not_null(main, lookup):
    out = relate(main, lookup, [on("id", "id")], "11", "sub", "l", order_by=["rank"])
    got = {r.name: r.j for r in out.select("name", F.to_json("l").alias("j")).collect()}
    assert got == {"a": '{"id":1,"name":"y","rank":5}', "b": '{"id":2,"rank":7}', "c": "{}", "d": "{}"}


def test_find_gives_null_without_match(main, lookup):
    got = {r.name: r.l for r in find(main, lookup, "l", [on("id", "id")], order_by=["rank"]).collect()}
    assert got["c"] is None and got["d"] is None and got["b"].rank == 7


def test_merge_lets_a_matched_null_win(main, lookup):
    out = relate(main, lookup, [on("id", "id")], "11", "sib", order_by=["rank"])
    assert rows(out.select("id", "name")) == sorted([(1, "y"), (2, None), (3, "c"), (None, "d")], key=repr)


def test_same_target_prefers_the_lookup(main, lookup):
    fields = {"s.name": "n", "r.name": "n"}
    out = relate(main, lookup, [on("id", "id")], "11", "sib", field_map=fields, order_by=["rank"])
    assert rows(out) == sorted([("y",), (None,), ("c",), ("d",)], key=repr)


def test_array_of_matches(main, lookup):
    out = relate(main, lookup, [on("id", "id")], "1n", "sub", "l")
    got = {r.name: r.l and [x.rank for x in r.l] for r in out.collect()}
    assert got == {"a": [10, 5], "b": [7], "c": None, "d": None}


@pytest.mark.parametrize("split_hot", [False, True])
@pytest.mark.parametrize("unmatched,expected", [
    ("passthrough", [(None, "a", 10), (None, "a", 5), (None, "b", 7), (3, "c", None), (None, "d", None)]),
    ("nulls", [(None, "a", 10), (None, "a", 5), (None, "b", 7), (None, "c", None), (None, "d", None)]),
    ("drop", [(None, "a", 10), (None, "a", 5), (None, "b", 7)]),
])
def test_unmatched_rows(main, lookup, unmatched, expected, split_hot):
    fields = {"s.name": "name", "r.rank": "rank"}
    out = relate(main, lookup, [on("id", "id")], "1n", "sib", field_map=fields, unmatched=unmatched, split_hot=split_hot)
    got = rows(out.select("id", "name", "rank") if unmatched == "passthrough" else out.select(F.lit(None).alias("id"), "name", "rank"))
    assert got == sorted(expected, key=repr)


def test_conditions():
    assert resolve_conditions([on("a", "x"), on("b", "y", 2.0)], ["a"]).constants == [("y", "2")]
    assert resolve_conditions([on("a", "x", "1")], ["a"]).pairs == [("a", "x")]
    cut = resolve_conditions([on("a", "x"), on("b", "y"), on("a", "z")], ["a"], "truncate")
    assert cut.pairs == [("a", "x")] and not cut.empty
    assert resolve_conditions([on("b", "y", "")], ["a"], "truncate").empty
    assert resolve_conditions([{"src_field": "a", "rel_field": "x"}], ["a"]).empty
    with pytest.raises(SpecError):
        resolve_conditions([on("b", "y")], ["a"])
    with pytest.raises(SpecError):
        resolve_conditions([], ["a"])
    assert [const_text(v) for v in (None, 3, 2.5, 4.0, "t")] == ["", "3", "2.500000", "4", "t"]


def test_constant_only_condition(main, lookup):
    fields = {"s.name": "m", "r.name": "l"}
    out = relate(main, lookup, [on("", "rank", 7.0)], "11", "sib", field_map={**fields, "r.id": "i"})
    assert rows(out) == [("a", None, 2), ("b", None, 2), ("c", None, 2), ("d", None, 2)]


@pytest.mark.parametrize("layer", ["sub", "sib"])
@pytest.mark.parametrize("assoc", ["11", "1n"])
def test_constants_plan_no_join(main, lookup, assoc, layer):
    fields = {"s.name": "m", "r.name": "l"}
    out = relate(main, lookup, [on("", "rank", 7.0)], assoc, layer, "l", fields if layer == "sib" else None)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 4
    none = relate(main, lookup, [on("", "rank", 70.0)], assoc, layer, "l", fields if layer == "sib" else None, unmatched="drop")
    assert none.count() == (0 if assoc == "1n" and layer == "sib" else 4 if assoc == "11" else 0)


def test_constants_with_all_matches(spark, main):
    lookup = spark.createDataFrame([(1, "x", {"a": 1}), (1, "y", None), (2, "z", None)], "t int, n string, m map<string,int>")
    nested = relate(main, lookup, [on("", "t", 1)], "1n", "sub", "all").collect()
    assert all(sorted(x.n for x in r["all"]) == ["x", "y"] for r in nested) and len(nested) == 4
    assert [r["all"] for r in relate(main, lookup, [on("", "t", 9)], "1n", "sub", "all").collect()] == [None] * 4
    assert relate(main, lookup, [on("", "t", 1)], "1n", "sib", field_map={}).count() == 8
    with pytest.raises(Exception, match="more than 1 rows"):
        relate(main, lookup, [on("", "t", 1)], "1n", "sub", "all", constant_rows=1).collect()
    merged = relate(main, lookup.drop("m"), [on("", "t", 2)], "11", "sib")
    assert {(r.t, r.n) for r in merged.collect()} == {(2, "z")}


def test_decimals_of_many_digits_do_not_overflow(spark):
    main = spark.createDataFrame([(1234567890123,), (5,), (6,)], "k bigint")
    lookup = spark.sql("SELECT CAST(v AS DECIMAL(38,30)) AS d, v FROM VALUES ('5'), ('6.000000000000000000000000000001') AS t(v)")
    out = relate(main, lookup, [on("k", "d")], "1n", "sib", field_map={"s.k": "k", "r.v": "v"}, unmatched="nulls")
    assert {(r.k, r.v) for r in out.collect()} == {(1234567890123, None), (5, "5"), (6, None)}


def test_field_map_rules(spark):
    parsed = {m.name: m for m in parse_field_map({"r.a": "x|i:bad", "b": "y", "q.c": "z|s:t", "a.b.c": "no", "r.d": "w|i:1|s:2"})}
    assert set(parsed) == {"x", "y", "z", "w"} and parsed["w"].default is None
    assert [parsed[n].side for n in "xyz"] == ["r", "s", "s"]
    with pytest.raises(SpecError):
        parse_field_map({"r.a": "x|i:1:2"})


def test_text_default_on_a_number(main, lookup):
    fields = {"s.name": "name", "r.rank": "rank|s:none"}
    out = relate(main, lookup, [on("id", "id")], "11", "sib", field_map=fields, order_by=["rank"])
    assert rows(out) == [("a", "5"), ("b", "7"), ("c", "none"), ("d", "none")]


def sibling_flow(unmatched="nulls", **options):
    step = lambda name, fields, source, rel, **more: {
        "type": "relateInline", "assoc_type": "1n", "layer_type": "sib", "relate_document_set": name, "unmatched": "nulls",
        "field_map": fields, "wheres": [on(source, rel)], **more,
    }
    second = step("second", {"s.r": "r", "s.s": "s", "r.t": "t"}, "s", "s", **options)
    return [step("first", {"s.r": "r", "r.s": "s"}, "r", "r"), {**second, "unmatched": unmatched}]


@pytest.mark.parametrize("split_hot", [False, True, 2])
def test_siblings_without_match_are_dropped(spark, split_hot):
    root = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,), (None,)], "r int")
    first = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (2, 21)] + [(4, 40 + i) for i in range(20)], "r int, s int")
    second = spark.createDataFrame([(10, "hit"), (45, "x"), (45, "y")], "s int, t string")
    frames = {"first": first, "second": second}
    expected = [(1, 10, "hit"), (2, 20, None), (2, 21, None), (3, None, None), (4, 45, "x"), (4, 45, "y"), (None, None, None), (None, None, None)]
    for key in (["r"], None):
        out, _ = run_flow(root, sibling_flow(split_hot=split_hot), lambda _r, name: frames[name], root=key)
        assert rows(out.select("r", "s", "t")) == sorted(expected, key=repr)
        out, _ = run_flow(root, sibling_flow("drop", split_hot=split_hot), lambda _r, name: frames[name], root=key)
        assert rows(out.select("r", "s", "t")) == sorted([e for e in expected if e[2]], key=repr)


def test_siblings_need_one_exchange_of_their_own(spark, tmp_path):
    for name, frame in (("root", "id AS r"), ("first", "id % 50 AS r, id AS s"), ("second", "id * 3 AS s, id AS t")):
        spark.range(100).selectExpr(*frame.split(", ")).write.parquet(str(tmp_path / name))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, _ = run_flow(read("root"), sibling_flow(), lambda _r, name: read(name), root=["r"])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # two for each join and one for the roots; each table is read once
    assert plan.count("Exchange hashpartitioning") <= 5 and plan.count("FileScan") == 3 and "monotonically" not in plan


def test_fields_without_an_order(spark, main):
    lookup = spark.sql("SELECT * FROM VALUES (1, map('a', 1)), (1, map('b', 2)) AS t(id, m)")
    nested = relate(main, lookup, [on("id", "id")], "1n", "sub", "l")
    assert {r.name: len(r.l or []) for r in nested.collect()} == {"a": 2, "b": 0, "c": 0, "d": 0}
    with pytest.raises(SpecError):
        relate(main, lookup, [on("id", "id")], "11", "sib", field_map={"r.m": "m"})
    ordered = lookup.withColumn("size", F.col("m")["a"])
    out = relate(main, ordered, [on("id", "id")], "11", "sib", field_map={"s.name": "n", "r.m": "m"}, order_by=["size"])
    assert {r.n: r.m for r in out.collect()}["a"] == {"b": 2}


# ---- hot keys

@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under key 0, another part without key."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id"))
    return spark.range(3000, numPartitions=6).select(key.alias("k"), F.lit("same").alias("v"), F.col("id"))


def test_hot_keys_are_found(skewed):
    hot = find_hot_keys(skewed, ["k"], 100)
    assert [(r.k, r["__n"]) for r in hot.frame.collect()] == [(0, 1000)] and hot.null_rows > 100 and not hot.overflow
    assert not find_hot_keys(skewed, ["k"], 5000)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, skewed, how):
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = find_hot_keys(skewed, ["k"], 100)
    salted = salted_join(skewed, right, ["k"], how, hot, rows_per_part=100)
    assert rows(salted.select("k", "id", "w")) == rows(skewed.join(right, "k", how).select("k", "id", "w"))


def test_cut_groups_bounds_the_parts(spark, skewed):
    cut = cut_groups(skewed.filter("k is not null"), ["k"], 100)
    sizes = cut.groupBy("k", "__part").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] == 100 and sizes[1] == skewed.filter("k is not null").count()


def test_long_arrays_are_cut_but_whole(spark, skewed):
    main = spark.createDataFrame([(0,), (1,), (-5,)], "k bigint")
    out = relate(main, skewed, [on("k", "k")], "1n", "sub", "l", array_rows=100)
    sizes = [(r.k, len(r.l) if r.l is not None else None) for r in out.collect()]
    assert len([s for s in sizes if s[0] == 0]) == 10 and sum(n for k, n in sizes if k == 0) == 1000
    assert [s for s in sizes if s[0] != 0] in ([(1, 1), (-5, None)], [(-5, None), (1, 1)])
    parts = sorted((r.k, r.l_part, r.l_parts) for r in out.collect())
    assert parts == [(-5, 0, 1), *[(0, i, 10) for i in range(10)], (1, 0, 1)]


@pytest.mark.parametrize("split_hot", [False, 50])
def test_arrays_are_cut_by_exact_counts(spark, split_hot):
    # 20,000 matches of one key, 250 of them the same row, 3,000 of another (just the limit) and rows without a key
    lookup = spark.range(24_000, numPartitions=5).selectExpr(
        "CASE WHEN id < 20000 THEN 1 WHEN id < 23000 THEN 2 END AS k", "CASE WHEN id < 250 THEN -1 ELSE id END AS v", "map('m', id) AS m"
    )
    main = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k bigint, name string")
    out = relate(main, lookup, [on("k", "k")], "1n", "sub", "l", array_rows=3000, split_hot=split_hot).collect()
    sizes = sorted((r.name, r.l_part, r.l_parts, None if r.l is None else len(r.l)) for r in out)
    whole = [(n, i, 7, 3000 if i < 6 else 2000) for n in "ab" for i in range(7)]
    assert sizes == [*whole, ("c", 0, 1, 3000), ("d", 0, 1, None)]
    for name in "ab":
        assert sorted(x.m["m"] for r in out if r.name == name for x in r.l) == list(range(20_000))


def test_cut_arrays_have_their_numbers_or_fail(spark):
    main = spark.createDataFrame([(1, 2)], "k bigint, l_part int")
    with pytest.raises(SpecError):
        relate(main, main.select("k"), [on("k", "k")], "1n", "sub", "l", array_rows=3)


def test_fan_out_with_a_hot_lookup_key(spark, skewed):
    main = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (-5, "d"), (None, "e")], "k bigint, name string")
    fields = {"s.name": "name", "r.id": "id"}
    split = relate(main, skewed, [on("k", "k")], "1n", "sib", field_map=fields, split_hot=100)
    plain = relate(main, skewed, [on("k", "k")], "1n", "sib", field_map=fields)
    assert rows(split.select("k", "name", "id")) == rows(plain.select("k", "name", "id"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows, rows_per_part, cell_rows", [(50, 100, 10_000), (50, 7, 10**9), (10**6, 10**6, 10**9), (20, 10**6, 400)])
def test_grid_join_equals_join(spark, skewed, how, hot_rows, rows_per_part, cell_rows):
    left = skewed.filter("id < 900")
    right = spark.range(600).selectExpr("CASE WHEN id % 4 = 0 THEN 0 WHEN id % 9 = 0 THEN NULL WHEN id % 3 = 0 THEN 21 ELSE id END AS k", "id AS w", "true AS hit")
    grid = grid_join(left, right, ["k"], how, "hit", hot_rows, rows_per_part, cell_rows)
    plain = left.join(right, "k", how)
    assert rows(grid.select("k", "id", "w")) == rows(plain.select("k", "id", "w"))
    empty = grid_join(left, right.limit(0), ["k"], how, "hit", hot_rows, rows_per_part, cell_rows)
    assert empty.count() == (left.count() if how == "left" else 0)


def test_grid_join_leaves_no_hot_task(spark):
    """One key with 90 % of both sides and rows without a key: 810,000 results, in even parts."""
    left = spark.range(3000).selectExpr("CASE WHEN id % 10 = 0 THEN NULL ELSE 7 END AS k", "id")
    right = spark.range(300).selectExpr("CASE WHEN id % 10 = 0 THEN id ELSE 7 END AS k", "id AS w", "true AS hit")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = grid_join(left, right, ["k"], "left", "hit", 100, 100, 2000)
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 2700 * 270 + 300 and max(sizes) <= 1.5 * sum(sizes) / 4


def test_cells_follow_the_results():
    class Hot:
        def __init__(self, frame):
            self.keys, self.frame = ["k"], frame
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    hot = lambda n: Hot(None if n is None else spark.createDataFrame([(1, n)], "k int, __n bigint"))
    grid = lambda a, b: tuple(_grid(hot(a), hot(b), 1_000_000, 100_000_000).select("__rows", "__cols").first())
    assert grid(5_000_000, None) == (5, 1)
    assert grid(None, 5_000_000) == (1, 5)
    assert grid(20_000, 20_000) == (2, 2)
    rows_, cols = grid(1_000_000, 1_000_000)
    assert 1_000_000 / rows_ * 1_000_000 / cols <= 100_000_000
    assert _grid(hot(None), hot(None), 1, 1) is None


def test_a_fine_grid_does_not_multiply_its_rows():
    """Limits of 20 rows, as a number given to split_hot sets them, against keys of many rows."""
    class Hot:
        def __init__(self, frame):
            self.keys, self.frame = ["k"], frame
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for n, m in [(400, 30), (410_000, 30_000), (2_400_000, 180_000), (5_000_000, 1)]:
        hot = [Hot(spark.createDataFrame([(1, x)], "k int, __n bigint")) for x in (n, m)]
        rows_, cols = _grid(*hot, 20, 400).select("__rows", "__cols").first()
        assert n / rows_ * m / cols <= 100_000_000 and n / rows_ <= 1_000_000
        assert n * cols + m * rows_ <= 70 * (n + m), (n, m, rows_, cols)
    assert rows_ > 1


@pytest.mark.parametrize("unmatched", ["drop", "passthrough"])
def test_numbers_that_fit_meet_hot_keys_without_copies(spark, unmatched):
    """One key with half of both sides; a lookup with text is dealt to cells, and rows without a key stay."""
    main = spark.range(2000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 3 = 0 THEN id END AS k", "id % 100 AS m")
    lookup = spark.range(300).selectExpr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END AS k", "id AS v")
    found = {}
    for kind, other in (("numbers", lookup), ("text", lookup.selectExpr("k", "cast(v AS string) AS v"))):
        run = lambda **more: relate(main, other, [on("k", "k")], "1n", "sib", unmatched=unmatched, **more).selectExpr("k", "m", "cast(v AS bigint) AS v")
        assert rows(run(split_hot=20)) == rows(run())
        found[kind] = run(split_hot=20)._jdf.queryExecution().executedPlan().toString()
    assert "explode" in found["text"] and "explode" not in found["numbers"]
    assert "BroadcastHashJoin" in found["numbers"] and "REPARTITION_BY_NUM" in found["numbers"]


def test_a_small_lookup_is_broadcast_and_pruned(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "id AS a", "id AS b").write.parquet(str(tmp_path / "lookup"))
    spark.range(1000).selectExpr("id AS k", "id AS m", "id AS unused").write.parquet(str(tmp_path / "main"))
    main, lookup = (spark.read.parquet(str(tmp_path / n)) for n in ("main", "lookup"))
    out = relate(main, lookup, [on("k", "k"), on("none", "b", 3)], "11", "sib", field_map={"s.m": "m", "r.a": "a"}, unique=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "unused" not in plan and "EqualTo(b,3)" in plan


def test_long_arrays_stay_whole(spark):
    lookup = spark.range(250_000).selectExpr("cast(0 as bigint) as k", "id")
    out = relate(spark.createDataFrame([(0,)], "k bigint"), lookup, [on("k", "k")], "1n", "sub", "l").collect()
    assert [len(r.l) for r in out] == [250_000]


def test_wide_keys_match_exactly(spark):
    main = spark.createDataFrame([(9007199254740993,)], "k bigint")
    lookup = spark.sql("SELECT cast(9007199254740992 + i AS decimal(20,0)) AS k, i AS v FROM (SELECT explode(array(0, 1)) AS i)")
    out = relate(main, lookup, [on("k", "k")], "1n", "sib", field_map={"s.k": "k", "r.v": "v"}).collect()
    assert [r.v for r in out] == [1]
