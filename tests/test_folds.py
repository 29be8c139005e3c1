"""The folds against a change-by-change replay of random logs."""

import random

import pytest
from pyspark.sql import functions as F

from rillway.operators.fold import fold_index, fold_table, log_position, outcomes, outcomes_scan, split_key_changes

SCHEMA = "k int, pos bigint, op string, a int, b string, present array<string>"


def random_log(seed, keys=40, changes=25, partial=False, snapshots=False):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        positions = sorted(rng.sample(range(1000), rng.randint(1, changes)))
        weights = rng.choice([(1, 1, 1), (5, 1, 3), (1, 4, 2), (2, 2, 8)])
        if snapshots and rng.random() < 0.5:
            rows.append((k, rng.randint(0, 300), "snapshot", rng.randint(0, 99), "base", ["a", "b"]))
        for p in positions:
            op = rng.choices(["insert", "delete", "update"], weights)[0]
            present = rng.choice([["a"], ["b"], ["a", "b"]]) if partial and op == "update" else ["a", "b"]
            a = rng.choice([None, rng.randint(0, 99)]) if "a" in present else None
            b = rng.choice([None, rng.choice("xyz")]) if "b" in present else None
            rows.append((k, p, op, a, b, present))
    return rows


def replay(rows, index):
    """State and outcome of every change, applied one after the other. A snapshot row replaces all before it."""
    state, result = {}, {}
    for k, pos, op, a, b, present in sorted(rows, key=lambda r: (r[0], r[1], r[2] == "snapshot")):
        doc = {"a": a, "b": b}
        if op == "snapshot":
            state[k] = doc
        elif op == "insert":
            result[k, pos] = "duplicate" if k in state else "applied"
            if index or k not in state:
                state[k] = doc
        elif op == "delete":
            result[k, pos] = "applied" if k in state else "no_row"
            state.pop(k, None)
        else:
            result[k, pos] = "applied" if k in state else "no_row"
            if k in state:
                state[k] = {**state[k], **{c: doc[c] for c in present}}
    return {k: (v["a"], v["b"]) for k, v in state.items()}, result


@pytest.mark.parametrize("snapshots", [False, True])
@pytest.mark.parametrize("partial", [False, True])
@pytest.mark.parametrize("index", [False, True])
def test_fold_equals_replay(spark, index, partial, snapshots):
    fold = fold_index if index else fold_table
    for seed in range(3):
        rows = random_log(seed, partial=partial, snapshots=snapshots)
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, SCHEMA)
        out = fold(df, ["k"], ["a", "b"], present="present" if partial else None)
        got = {r.k: (r.a, r.b) for r in out.collect()}
        assert got == replay(rows, index)[0]


def test_fold_ignores_repeated_changes(spark):
    rows = random_log(11)
    df = spark.createDataFrame(rows + rows[::3], SCHEMA)
    assert {r.k: (r.a, r.b) for r in fold_table(df, ["k"], ["a", "b"]).collect()} == replay(rows, False)[0]


def test_replay_after_snapshot_changes_nothing(spark):
    rows = random_log(5)
    state, _ = replay(rows, False)
    last = {}
    for k, pos, *_ in rows:
        last[k] = max(pos, last.get(k, -1))
    base = [(k, last[k], "snapshot", a, b, None) for k, (a, b) in state.items()]
    gone = [(k, last[k], "delete", None, None, None) for k in last if k not in state]
    df = spark.createDataFrame(base + gone + rows[::2], SCHEMA)
    assert {r.k: (r.a, r.b) for r in fold_table(df, ["k"], ["a", "b"]).collect()} == state


@pytest.mark.parametrize("hot_rows", [1_000_000, 7])
def test_outcomes_equal_replay(spark, hot_rows):
    rows = random_log(3, keys=30, changes=60)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.k, r.pos): r.outcome for r in outcomes(df, ["k"], hot_rows=hot_rows).collect()}
    assert got == replay(rows, False)[1]


def test_key_change_moves_the_row(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, "insert", "x"), (2, 1, 2, "update", "y"), (1, 2, 3, "update", "z"), (5, 5, 4, "insert", "q")],
        "k int, old int, pos bigint, op string, v string",
    )
    split = split_key_changes(df, ["k"], ["old"])
    assert {(r.k, r.v) for r in fold_table(split, ["k"], ["v"]).collect()} == {(1, "z"), (5, "q")}


def test_fold_shuffles_one_row_per_key_and_task(spark):
    df = spark.range(1000).select(
        F.lit(1).alias("k"), F.col("id").alias("pos"), F.lit("update").alias("op"), F.col("id").alias("v")
    )
    plan = fold_index(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("partial_max_by") >= 1


@pytest.mark.parametrize("bits, levels", [(1, 1), (2, 3), (5, 2), (16, 2)])
@pytest.mark.parametrize("shift", [0, 40])
def test_scan_equals_replay(spark, bits, levels, shift):
    rows = [(None if r[0] == 4 else r[0], r[1] << shift, *r[2:]) for r in random_log(11, keys=12, changes=200, snapshots=True)]
    expected = {(r[0], r[1], r[2]): o for r in rows if (o := replay([(-1 if x[0] is None else x[0], *x[1:]) for x in rows], False)[1].get((-1 if r[0] is None else r[0], r[1]))) and r[2] != "snapshot"}
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = outcomes_scan(df, ["k"], bits=bits, levels=levels)
    assert out.columns == [*df.columns, "outcome"]
    got = {(r.k, r.pos, r.op): r.outcome for r in out.collect() if r.op != "snapshot"}
    assert got == expected and out.count() == len(rows)


def test_scan_of_an_empty_log_and_of_repeats(spark):
    assert outcomes_scan(spark.createDataFrame([], SCHEMA), ["k"]).count() == 0
    rows = [(1, 5, "insert", 1, "x", None)] * 3 + [(1, 6, "delete", None, None, None)] * 2
    two = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("a", "a.b")
    assert outcomes_scan(two, ["k", "b"], bits=1).count() == 5


@pytest.mark.parametrize("key", ["CAST(5 AS BIGINT)", "CAST(NULL AS BIGINT)"])
def test_scan_leaves_no_task_with_a_hot_key(spark, key):
    """90 % of the rows on one key, or without one: windows and joins of rows see even parts."""
    log = spark.range(60_000).selectExpr(f"CASE WHEN id % 10 > 0 THEN {key} ELSE id END AS k", "id * 3 AS pos", "CASE id % 7 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'update' END AS op")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = outcomes_scan(log, ["k"], bits=8)
        assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 60_000 and max(sizes) <= 2 * 60_000 / 4


def test_offsets_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(log_position(F.lit(1), F.lit(2**40))).collect()
