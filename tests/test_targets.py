"""Keyed targets, tasks, sinks and streams."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from test_folds import SCHEMA, random_log, replay

from rillway.columns import ALIAS, DOC_SET, ID_VALUE, OP, POS
from rillway.operators.keyed import delete_rows, insert_rows, update_rows
from rillway.operators.steps import SpecError
from rillway.plans.task import build_task, check_task, load_task, start_task, target_state, task_metrics, write_task
from rillway.sinks import quality, writers
from rillway.sinks.target import KeyedTarget
from rillway.streaming import runner


def state_of(df):
    return {r.k: (r.a, r.b) for r in df.collect()}


@pytest.mark.parametrize("kind", ["table", "index"])
def test_target_in_batches_equals_replay(spark, tmp_path, kind):
    rows = sorted(random_log(7, keys=15, changes=30), key=lambda r: r[1])
    target = KeyedTarget(spark, str(tmp_path / kind), ["k"], ["a", "b"], kind)
    assert target.read() is None
    step = len(rows) // 4
    for i in range(4):
        part = rows[i * step:(i + 1) * step if i < 3 else None]
        target.append_batch(spark.createDataFrame(part, SCHEMA), i)
        if i % 2:
            target.compact()
        assert state_of(target.read()) == replay(rows[:(i + 1) * step if i < 3 else None], kind == "index")[0]


def test_repeated_batches_and_old_changes_do_nothing(spark, tmp_path):
    rows = sorted(random_log(8, keys=10, changes=20), key=lambda r: r[1])
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA)
    target.append_batch(df, 0)
    target.append_batch(df, 0)
    target.compact()
    target.append_batch(spark.createDataFrame(rows[: len(rows) // 2], SCHEMA), 1)
    target.compact()
    assert state_of(target.read()) == replay(rows, False)[0]


@pytest.mark.parametrize("kind", ["table", "index"])
def test_refused_changes_of_each_batch(spark, tmp_path, kind):
    rows = sorted(random_log(9, keys=12, changes=30), key=lambda r: r[1])
    bad = "duplicate" if kind == "table" else "no_row"
    outcome = replay(rows, kind == "index")[1]
    expected = {(r[0], r[1]) for r in rows if outcome[r[0], r[1]] == bad and (kind == "table" or r[2] == "update")}
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], ["a", "b"], kind)
    got, step = set(), len(rows) // 3 + 1
    for i in range(3):
        # every batch repeats the end of the one before
        part = spark.createDataFrame(rows[max(0, i * step - 4):(i + 1) * step], SCHEMA)
        fresh = {(r[0], r[1]) for r in rows[i * step:(i + 1) * step]}
        target.append_batch(part, i)
        refused = {(r.k, r.pos) for r in target.refused(i).collect()}
        assert refused <= fresh
        got |= refused
        if i == 1:
            target.compact()
    assert got == expected and target.contains(1) and not target.contains(2)


def test_a_stream_begun_anew_is_not_taken_for_the_old_one(spark, tmp_path):
    target = KeyedTarget(spark, str(tmp_path / "out"), ["k"], ["a", "b"], "index")
    go = lambda n: runner.start_apply(
        runner.change_stream(spark, str(tmp_path / f"in{n}"), SCHEMA), target, str(tmp_path / f"check{n}"), once=True, compact_every=1
    ).awaitTermination()
    target.merge(spark.createDataFrame([(1, 1, "insert", 1, "x", None), (2, 1, "insert", 1, "y", None)], SCHEMA))
    for n, row in enumerate([(1, 5, "insert", 5, "z", None), (3, 6, "insert", 6, "w", None)]):
        write_files(spark, [row], str(tmp_path / f"in{n}"), 1)
        go(n)
    assert state_of(target.read()) == {1: (5, "z"), 2: (1, "y"), 3: (6, "w")}
    target.merge(spark.createDataFrame([(2, 9, "delete", None, None, None)], SCHEMA))
    assert state_of(target.read()) == {1: (5, "z"), 3: (6, "w")}


def test_keyed_task_can_run_again(spark, tmp_path):
    s = {
        "resource": [{"id": "in", "type": "parquet", "path": str(tmp_path / "in")}, {"id": "out", "type": "parquet", "path": str(tmp_path / "out")}],
        "source": [{"resource_id": "in", "sync_mode": "stream", "document_set": "log", "extra": {"pk": "k"}}],
        "target": [{"resource_id": "out", "document_set": {"log": "state"}, "extra": {"keyed": "table", "key": "k"}}],
    }
    rows = sorted(random_log(4, keys=8, changes=12), key=lambda r: r[1])
    df = spark.createDataFrame(rows, SCHEMA).drop("present")
    half = rows[len(rows) // 2][1]
    for part in (f"pos <= {half}", f"pos > {half}"):
        df.filter(part).write.mode("append").parquet(str(tmp_path / "in/log"))
        assert write_task(build_task(spark, s), s)["out/state"]["rows"] > 0
    target = KeyedTarget(spark, str(tmp_path / "out/state"), ["k"], ["a", "b"], "table", POS, OP)
    assert state_of(target.read()) == replay(rows, False)[0]


def test_unfinished_base_is_not_read(spark, tmp_path):
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], ["a", "b"])
    rows = [(1, 1, "insert", 5, "x", None)]
    target.append_batch(spark.createDataFrame(rows, SCHEMA), 0)
    spark.createDataFrame([(9, 9, "snapshot", 1, "y", None)], SCHEMA).write.parquet(str(tmp_path / "t/base/version=1"))
    assert state_of(target.read()) == {1: (5, "x")}
    target.compact()
    assert state_of(target.read()) == {1: (5, "x")}


def write_files(spark, rows, folder, parts):
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step:(i + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_replay_in_any_order(spark, tmp_path):
    rows = random_log(21, keys=12, changes=20)
    random.Random(1).shuffle(rows)
    write_files(spark, rows, str(tmp_path / "in"), 3)
    target = KeyedTarget(spark, str(tmp_path / "out"), ["k"], ["a", "b"])
    stream = runner.change_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
    query = runner.start_apply(stream, target, str(tmp_path / "check"), once=True, compact_every=0)
    query.awaitTermination()
    metrics = runner.progress_metrics(query)
    assert metrics["full_read_count"] == len(rows) and metrics["batches"] == 3 and runner.state(query) == "done"
    assert state_of(target.read()) == replay(rows, False)[0]
    assert list(target._last_batches().values()) == [2]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = sorted(random_log(22, keys=12, changes=20), key=lambda r: r[1])
    half = len(rows) // 2
    target = KeyedTarget(spark, str(tmp_path / "out"), ["k"], ["a", "b"], "index")
    go = lambda: runner.start_apply(
        runner.change_stream(spark, str(tmp_path / "in"), SCHEMA), target, str(tmp_path / "check"), once=True, compact_every=1
    ).awaitTermination()
    write_files(spark, rows[:half], str(tmp_path / "in"), 1)
    go()
    assert state_of(target.read()) == replay(rows[:half], True)[0]
    write_files(spark, rows[half:], str(tmp_path / "in"), 1)
    go()
    go()
    assert state_of(target.read()) == replay(rows, True)[0]
    assert list(target._last_batches().values()) == [1]


def test_lookup_is_read_per_batch(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "in"))
    lookup = lambda: spark.read.parquet(str(tmp_path / "lookup"))
    spark.sql("SELECT 0L AS id, 'old' AS v").write.parquet(str(tmp_path / "lookup"))
    stream = lambda: runner.change_stream(spark, str(tmp_path / "in"), "id bigint")
    go = lambda: runner.start_append(
        stream(), str(tmp_path / "out"), str(tmp_path / "check"), lambda b: b.join(lookup(), "id"), once=True
    ).awaitTermination()
    go()
    spark.sql("SELECT 0L AS id, 'new' AS v").write.mode("overwrite").parquet(str(tmp_path / "lookup"))
    spark.range(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["new", "old"]


def test_checkpoint_root(spark):
    assert runner.checkpoint_root(spark, "/x") in ("/x", spark.conf.get("spark.checkpoint.dir", "/x"))


# ---- batch writes

def test_insert_update_delete(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x", 1), (3, "y", 2), (3, "z", 3)], "k int, v string, pos int")
    inserted, refused = insert_rows(target, batch, ["k"], "pos")
    assert sorted(tuple(r) for r in inserted.collect()) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(r.pos for r in refused.collect()) == [1, 3]
    assert sorted(tuple(r) for r in update_rows(target, batch, ["k"], "pos").collect()) == [(1, "a"), (2, "x")]
    assert [r.k for r in delete_rows(target, batch, ["k"]).collect()] == [1]


def test_route_falls_back_to_the_document_set(spark):
    df = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "u")], f"{ALIAS} string, {DOC_SET} string")
    out = writers.route(df, [{"id": "x", "document_set": {"a": "one", "t": ""}}])
    assert {r[ALIAS]: (r._target, r._target_set) for r in out.collect()} == {"a": ("x", "one"), "b": ("x", "t"), "c": (None, None)}


def test_object_lines_refuse_other_operations(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "insert"), (2, "x", "update")], f"a int, b string, {OP} string")
    refused = writers.write_object_lines(df, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1,"b":null}']
    assert [r.a for r in refused.collect()] == [2]


def test_health_and_rate(spark):
    df = spark.createDataFrame([("stop", 0), ("run", 1), ("run", 0), ("init", 3)], "s string, n int")
    assert [r[0] for r in df.select(quality.health(F.col("s"), F.col("n"))).collect()] == ["red", "yellow", "green", "none"]
    assert spark.range(1).select(quality.rows_per_second(F.lit(7), F.lit(2))).first()[0] == "3/s"


# ---- tasks

def spec(tmp_path, **target_extra):
    return {
        "resource": [{"id": "in", "type": "parquet", "path": str(tmp_path / "in")}, {"id": "out", "type": "json", "path": str(tmp_path / "out")}],
        "source": [
            {"resource_id": "in", "sync_mode": "direct", "document_set": {"items": ["a", "b", "c"]}, "extra": {"pk": "id"}},
            {"resource_id": "in", "sync_mode": "empty", "document_set": ""},
        ],
        "target": [{"resource_id": "out", "document_set": {"a": "first", "b": "second"}, "extra": target_extra}],
        "pipeline": [
            {"document_set": "a", "flow": [{"type": "map", "set": {"v": "1"}}]},
            {"document_set": "a,b", "flow": [
                {"type": "filter", "where": "id > 1"},
                {"type": "relateInline", "assoc_type": "1n", "relate_resource_id": "in", "relate_document_set": "tags",
                 "layer_type": "sub", "sub_label": "tags", "wheres": [{"src_field": "id", "operator": "=", "rel_field": "item"}]},
            ]},
        ],
    }


def test_task_runs_from_files_to_files(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y"), (0, "z")], "id int, name string").write.parquet(str(tmp_path / "in/items"))
    spark.createDataFrame([(1, "t"), (1, "s")], "item int, tag string").write.parquet(str(tmp_path / "in/tags"))
    task = build_task(spark, spec(tmp_path))
    assert task.unrouted == ["c"] and task.frames["c"].count() == 3
    written = write_task(task, spec(tmp_path))
    assert {k: v["rows"] for k, v in written.items()} == {"out/first": 2, "out/second": 2}
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out/first")).collect())
    assert lines == ['{"id":0,"name":"z","tags":null}', '{"id":1,"name":"x","tags":[{"item":1,"tag":"s"},{"item":1,"tag":"t"}]}']
    assert task.frames["a"].select(ID_VALUE).distinct().count() == 2


def test_task_with_queue_format(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id int, name string").write.parquet(str(tmp_path / "in/items"))
    s = {**spec(tmp_path, format=True), "pipeline": []}
    write_task(build_task(spark, s), s)
    assert [r.value for r in spark.read.text(str(tmp_path / "out/first")).collect()] == ['{"OptionType":"insert","data":{"id":1,"name":"x"}}']


@pytest.mark.parametrize("change", [
    {"space": []}, {"resource": []}, {"source": []}, {"target": []},
    {"resource": [{"id": "in", "type": "tape"}]},
    {"source": [{"resource_id": "no", "sync_mode": "direct", "document_set": "a"}]},
    {"source": [{"resource_id": "in", "sync_mode": "backwards", "document_set": "a"}]},
    {"target": [{"resource_id": "out", "document_set": {}}]},
    {"pipeline": [{"document_set": "zz", "flow": [{"type": "filter", "where": "true"}]}]},
    {"pipeline": [{"document_set": "a", "flow": []}]},
    {"pipeline": [{"document_set": "a", "flow": [{"type": "find", "into": "x", "wheres": [{}], "relate_resource_id": "out", "relate_document_set": "t"}]}]},
])
def test_bad_specs_are_refused(tmp_path, change):
    with pytest.raises(SpecError):
        check_task({**spec(tmp_path), **change})


@pytest.mark.parametrize("path", sorted(glob.glob(os.path.join(os.path.dirname(__file__), "../examples/*.json"))))
def test_examples_are_valid(path):
    assert load_task(path)["target"]


def test_enrich_example_runs(spark, tmp_path):
    s = load_task(os.path.join(os.path.dirname(__file__), "../examples/enrich.json"))
    s["resource"][0]["path"], s["resource"][1]["path"] = "/root/testdata/sf0.001", str(tmp_path)
    task = build_task(spark, s)
    written = write_task(task, s)
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    assert written["out/names"]["rows"] == customers.count()
    assert written["out/clients_live"]["rows"] == customers.filter("c_acctbal <= 5000").count()
    assert set(spark.read.json(str(tmp_path / "clients_live")).columns) == {"client_no", "client_name", "batch_no", "nation", "orders"}


def test_task_metrics(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 1.0)], "id int, d double").write.parquet(str(tmp_path / "in/items"))
    s = spec(tmp_path)
    s["pipeline"] = [{"document_set": "a", "flow": [
        {"type": "map", "set": {"r": "if(d = 0, double('NaN'), 1 / d)"}, "check_numbers": True}, {"type": "filter", "where": "id = 2"},
    ]}]
    task = build_task(spark, s)
    got = {r.alias: (r.full_read_count, r.full_delivery_count, r.failed_pipeline_count) for r in task_metrics(task).collect()}
    assert got == {"a": (3, 2, 1), "b": (3, 3, 0), "c": (3, 3, 0)}
    assert task.outputs["out", "first"].count() == 1


# ---- streaming tasks

def queue_spec(tmp_path, **target_extra):
    return {
        "setup": {"error_record": True},
        "resource": [
            {"id": "mq", "type": "queue", "path": str(tmp_path / "mq")}, {"id": "files", "type": "parquet", "path": str(tmp_path / "in")},
            {"id": "out", "type": "parquet", "path": str(tmp_path / "out")},
        ],
        "source": [
            {"resource_id": "mq", "sync_mode": "stream", "document_set": "orders",
             "extra": {"schema": "id int, n bigint, tag int, name string", "pk": "id", "pos": "n", "limit": 1}},
            {"resource_id": "files", "sync_mode": "empty", "document_set": ""},
        ],
        "target": [{"resource_id": "out", "document_set": {"orders": "orders_copy"}, "extra": target_extra}],
        "pipeline": [{"document_set": "orders", "flow": [
            {"type": "relateInline", "assoc_type": "11", "relate_resource_id": "files", "relate_document_set": "tags", "layer_type": "sib",
             "field_map": {"id": "id", "name": "name", "r.label": "label|s:none"}, "unique": True,
             "wheres": [{"src_field": "tag", "operator": "=", "rel_field": "tag"}]}]}],
    }


def send(spark, tmp_path, texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "mq/orders"))


def test_queue_task_folds_into_a_keyed_target(spark, tmp_path):
    spark.createDataFrame([(7, "seven")], "tag int, label string").write.parquet(str(tmp_path / "in/tags"))
    spec = queue_spec(tmp_path, keyed="index", key="id", compact_every=1)
    go = lambda: [q.awaitTermination() for q in start_task(spark, spec, str(tmp_path / "state"), once=True).values()]
    send(spark, tmp_path, ['{"id":1,"n":1,"tag":7,"name":"a"}', '{"id":2,"n":2,"tag":8,"name":"b"}', "{broken"])
    go()
    send(spark, tmp_path, ['{"OptionType":"delete","data":{"id":2,"n":3}}', '{"OptionType":"update","data":{"id":1,"n":4,"name":"c"}}',
                          '{"OptionType":"update","data":{"id":9,"n":5,"name":"z"}}'])
    go()
    target = KeyedTarget(spark, str(tmp_path / "out/orders_copy"), ["id"], ["name", "label"], "index", POS, OP)
    assert [(r.id, r.name, r.label) for r in target.read().collect()] == [(1, "c", "none")]
    letters = spark.read.parquet(str(tmp_path / "state/errors")).collect()
    assert sorted((r.stage, r.reason, r.alias, r.doc_json) for r in letters) == [
        ("delivery", "document missing", "orders", '{"id":9,"name":"z","label":"none"}'), ("read", "bad json", "orders", "{broken"),
    ]


def test_text_sources_in_a_batch_task(spark, tmp_path):
    spark.createDataFrame([('{"a":1}',), ("no",)], "value string").write.text(str(tmp_path / "in/lines"))
    spec = {
        "resource": [{"id": "in", "type": "lines", "path": str(tmp_path / "in")}, {"id": "none", "type": "empty"}],
        "source": [{"resource_id": "in", "sync_mode": "direct", "document_set": "lines", "extra": {"schema": "a int", "pk": "a"}}],
        "target": [{"resource_id": "none", "document_set": {"lines": ""}}],
        "pipeline": [],
    }
    task = build_task(spark, spec)
    assert write_task(task, spec) == {"none/lines": {"rows": 1}}
    assert [(r.stage, r.doc_json) for r in task.errors.collect()] == [("read", "no")]


def test_change_log_task_resumes(spark, tmp_path):
    rows = [(1, 1, "insert", "a"), (1, 2, "update", "b"), (2, 3, "insert", "c"), (1, 4, "delete", "b")]
    spark.createDataFrame(rows, "id int, pos bigint, op string, name string").write.parquet(str(tmp_path / "in/log"))
    spec = {
        "resource": [{"id": "in", "type": "parquet", "path": str(tmp_path / "in")}, {"id": "none", "type": "empty"}],
        "source": [{"resource_id": "in", "sync_mode": "stream", "document_set": {"log": "users"}, "extra": {"pk": "id", "resume_after": 2}}],
        "target": [{"resource_id": "none", "document_set": {"users": "users"}}],
        "pipeline": [],
    }
    frame = build_task(spark, spec).frames["users"]
    assert sorted((r[ID_VALUE], r[OP], r[POS]) for r in frame.collect()) == [("1", "delete", 4), ("2", "insert", 3)]
    assert [r.id for r in target_state(frame, "table", "id").collect()] == [2]


def test_replica_skips_its_snapshot_when_it_resumes(spark, tmp_path):
    spark.createDataFrame([(1, "z"), (5, "z")], "id int, name string").write.parquet(str(tmp_path / "in/users"))
    rows = [(1, 3, "update", "b"), (2, 4, "insert", "c")]
    spark.createDataFrame(rows, "id int, pos bigint, op string, name string").write.parquet(str(tmp_path / "in/log"))

    def positions(saved):
        extra = {"pk": "id", "changes": "log", **({} if saved is None else {"resume_after": saved})}
        spec = {
            "resource": [{"id": "in", "type": "parquet", "path": str(tmp_path / "in")}, {"id": "none", "type": "empty"}],
            "source": [{"resource_id": "in", "sync_mode": "replica", "document_set": "users", "extra": extra}],
            "target": [{"resource_id": "none", "document_set": {"users": "users"}}],
        }
        frame = build_task(spark, spec).frames["users"]
        return sorted(r[POS] for r in frame.collect())

    assert positions(None) == [-1, -1, 3, 4]
    assert positions(3) == [4]
    # the log begins after the saved position: something may be missing, so all is read again
    assert positions(1) == [-1, -1, 3, 4]


@pytest.mark.parametrize("change", [
    {"source": [{"resource_id": "mq", "sync_mode": "direct", "document_set": "orders", "extra": {"schema": "id int"}}]},
    {"source": [{"resource_id": "mq", "sync_mode": "stream", "document_set": "orders"}]},
    {"source": [{"resource_id": "files", "sync_mode": "replica", "document_set": "orders"}]},
    {"target": [{"resource_id": "out", "document_set": {"orders": "x"}, "extra": {"keyed": "tree"}}]},
    {"target": [{"resource_id": "out", "document_set": {"orders": "x"}, "extra": {"keyed": "table"}}]},
])
def test_bad_stream_specs_are_refused(tmp_path, change):
    with pytest.raises(SpecError):
        check_task({**queue_spec(tmp_path), **change})


def test_cut_arrays_are_refused_for_keyed_targets(tmp_path):
    s = spec(tmp_path, keyed="index", key="id")
    check_task(s)
    s["pipeline"][1]["flow"][1]["array_rows"] = 10
    with pytest.raises(SpecError, match="array_rows"):
        check_task(s)
    s["target"][0]["extra"] = {}
    check_task(s)


def test_changes_without_a_key_are_refused(spark, tmp_path):
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], ["v"])
    for batch in range(3):
        rows = spark.createDataFrame([(None, batch, "insert", "x"), (batch, batch, "insert", "y")], "k int, pos bigint, op string, v string")
        target.append_batch(rows.withColumnsRenamed({"op": target.op, "pos": target.pos}), batch)
        assert [(r.k, r.reason) for r in target.refused(batch).collect()] == [(None, "null key")]
        target.compact()
    assert sorted(r.k for r in target.read().collect()) == [0, 1, 2]


ROWS = "k int, pos bigint, op string, a int, b string, present array<string>"


def test_two_compactions_at_once_lose_nothing(spark, tmp_path):
    one, two = (KeyedTarget(spark, str(tmp_path / "t"), ["k"], ["a", "b"]) for _ in range(2))
    seen = one._committed()
    one.append_batch(spark.createDataFrame([(1, 1, "insert", 1, "x", None)], ROWS), 0, "s1")
    two.append_batch(spark.createDataFrame([(2, 1, "insert", 2, "y", None)], ROWS), 0, "s2")
    for target, stream in ((one, "s1"), (two, "s2")):    # both start from the same base
        base, log = target._parts({stream: 0}, seen)
        target._commit(target._fold(base, log, removed=True), {stream: 0}, seen)
        assert state_of(target.read()) == {1: (1, "x"), 2: (2, "y")}
    one.compact("s1", 0)
    two.compact("s2", 0)
    assert one.contains(0, "s1") and one.contains(0, "s2")
    assert state_of(one.read()) == {1: (1, "x"), 2: (2, "y")}
    # a base made from the rows before a reload does not bring them back
    seen = one._committed()
    state = one._fold(*one._parts({"s1": 0, "s2": 0}, seen), removed=True)
    two.rebuild(spark.createDataFrame([(3, 0, "insert", 3, "z", None)], ROWS))
    one._commit(state, {"s1": 0, "s2": 0}, seen)
    assert state_of(one.read()) == {3: (3, "z")}


def test_a_batch_in_the_making_stays_in_the_log(spark, tmp_path):
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], ["a", "b"])
    target.append_batch(spark.createDataFrame([(1, 1, "insert", 1, "x", None)], ROWS), 0, "s1")
    target.append_batch(spark.createDataFrame([(2, 1, "insert", 2, "y", None)], ROWS), 0, "s2")
    target.compact("s1", 0)
    assert target.contains(0, "s1") and not target.contains(0, "s2")
    target.append_batch(spark.createDataFrame([(2, 1, "insert", 2, "y", None), (3, 1, "insert", 3, "z", None)], ROWS), 0, "s2")
    assert state_of(target.read()) == {1: (1, "x"), 2: (2, "y"), 3: (3, "z")}


@pytest.mark.parametrize("kind", ["table", "index"])
@pytest.mark.parametrize("partial", [True, False])
def test_late_changes_do_not_depend_on_compaction(spark, tmp_path, kind, partial):
    rows = [r for r in random_log(31, keys=30, changes=12, partial=partial) if kind == "index" or r[2] != "insert"]
    if kind == "table":     # a key is inserted once; what comes late are its updates and deletes
        rows = [(k, -1, "insert", k, "first", None) for k in {r[0] for r in rows}] + rows
    random.Random(3).shuffle(rows)
    present = "present" if partial else None
    plain = spark.createDataFrame(rows, ROWS)
    expected = KeyedTarget(spark, str(tmp_path / "whole"), ["k"], ["a", "b"], kind, present=present)
    expected.append_batch(plain, 0)
    target = KeyedTarget(spark, str(tmp_path / "parts"), ["k"], ["a", "b"], kind, present=present)
    for i in range(3):
        target.append_batch(spark.createDataFrame(rows[i::3], ROWS), i)
        target.compact()
    assert state_of(target.read()) == state_of(expected.read())


def test_a_target_takes_a_new_column(spark, tmp_path):
    old = KeyedTarget(spark, str(tmp_path / "t"), ["k"], ["a"])
    old.append_batch(spark.createDataFrame([(1, 1, "insert", 1, "-", None)], ROWS), 0)
    old.compact()
    old.append_batch(spark.createDataFrame([(2, 1, "insert", 2, "-", None)], ROWS), 1)
    new = KeyedTarget(spark, str(tmp_path / "t"), ["k"], ["a", "b"])
    assert state_of(new.read()) == {1: (1, None), 2: (2, None)}
    new.append_batch(spark.createDataFrame([(3, 1, "insert", 3, "z", None), (1, 2, "update", 4, "n", None)], ROWS), 2)
    assert state_of(new.read()) == {1: (4, "n"), 2: (2, None), 3: (3, "z")}
    new.compact()
    assert state_of(new.read()) == {1: (4, "n"), 2: (2, None), 3: (3, "z")}


def test_running_replica_takes_its_snapshot_once(spark, tmp_path):
    log = "k int, pos bigint, op string, a int, b string"
    s = {
        "resource": [{"id": "in", "type": "parquet", "path": str(tmp_path / "in")}, {"id": "out", "type": "parquet", "path": str(tmp_path / "out")}],
        "source": [{"resource_id": "in", "sync_mode": "replica", "document_set": {"rows": "r"}, "extra": {"pk": "k", "changes": "log", "schema": log}}],
        "target": [{"resource_id": "out", "document_set": {"r": "state"}, "extra": {"keyed": "table", "key": "k", "compact_every": 1}}],
    }
    spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "k int, a int, b string").write.parquet(str(tmp_path / "in/rows"))
    target = KeyedTarget(spark, str(tmp_path / "out/state"), ["k"], ["a", "b"], "table", POS, OP)
    steps = [([(1, 5, "update", 9, "u"), (3, 6, "insert", 3, "z")], {1: (9, "u"), 2: (2, "y"), 3: (3, "z")}), ([(2, 7, "delete", None, None)], {1: (9, "u"), 3: (3, "z")})]
    for changes, state in steps:
        spark.createDataFrame(changes, log).coalesce(1).write.mode("append").parquet(str(tmp_path / "in/log"))
        for query in start_task(spark, s, str(tmp_path / "run"), once=True).values():
            query.awaitTermination()
        assert state_of(target.read()) == state
    s["target"][0]["extra"] = {}
    with pytest.raises(SpecError):
        start_task(spark, s, str(tmp_path / "run2"), once=True)
