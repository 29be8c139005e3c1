"""Sets of a partitioned resource: one scan for a flow, one job, one stream; hits of an index keep their ids."""

import pytest

from rillway.operators.steps import SpecError
from rillway.plans.task import build_task, check_task, run_task, start_task, stream_metrics, write_task
from rillway.sinks.writers import TARGET_SET

LOG = "id int, pos bigint, op string, d double"
ROWS = [(1, 1, "insert", 1.0), (2, 2, "insert", 0.0), (1, 3, "update", 5.0), (3, 4, "insert", 7.0), (4, 5, "delete", 2.0), (5, 6, "insert", 9.0)]
FLOW = [{"type": "map", "set": {"r": "if(d = 0, double('NaN'), 1 / d)"}, "check_numbers": True}, {"type": "filter", "where": "d = 9"}]


def spec(tmp_path, kind="lines", aliases=("a", "b", "c"), **extra):
    return {
        "setup": {"error_record": True},
        "resource": [
            {"id": "in", "type": "parquet", "path": str(tmp_path / "in")}, {"id": "out", "type": kind, "path": str(tmp_path / "out"), "partitioned": True},
        ],
        "source": [{"resource_id": "in", "sync_mode": "stream", "document_set": {"log": list(aliases)}, "extra": {"pk": "id", "schema": LOG, "limit": 1}}],
        "target": [{"resource_id": "out", "document_set": {"a": "x", "b": "y", "log": ""}, "extra": extra}],
        "pipeline": [{"document_set": "a", "flow": FLOW}],
    }


@pytest.fixture
def log(spark, tmp_path):
    spark.createDataFrame(ROWS, LOG).repartition(3).write.parquet(str(tmp_path / "in/log"))


def counts(df):
    return {r.alias: (r.full_read_count, r.full_delivery_count, r.failed_delivery_count, r.failed_pipeline_count) for r in df.collect()}


LINES = {"a": (6, 3, 2, 1), "b": (6, 4, 2, 0), "c": (6, 4, 2, 0)}


def stored(spark, tmp_path):
    return {r.target: r["count"] for r in spark.read.text(str(tmp_path / "out")).groupBy("target").count().collect()}


def test_batch_run_writes_all_sets(spark, tmp_path, log):
    got = run_task(spark, spec(tmp_path), str(tmp_path / "run"))
    # c has no target of its own, its document set has one without a name
    assert counts(got) == LINES and stored(spark, tmp_path) == {"x": 2, "y": 4, "log": 4}
    letters = sorted((r.stage, r.alias) for r in spark.read.parquet(str(tmp_path / "run/errors")).collect())
    assert letters == [("delivery", "a")] * 2 + [("delivery", "b")] * 2 + [("delivery", "c")] * 2 + [("pipeline", "a")]
    again = run_task(spark, spec(tmp_path, mode="overwrite"), str(tmp_path / "run"))
    assert counts(again) == LINES and stored(spark, tmp_path) == {"x": 2, "y": 4, "log": 4}


def test_aliases_of_one_flow_are_one_scan_and_one_job(spark, tmp_path, log):
    s = spec(tmp_path, "parquet", aliases=[f"a{i}" for i in range(20)])
    s["target"] = [{"resource_id": "out", "document_set": {f"a{i}": f"x{i}" for i in range(20)}}]
    s["pipeline"] = [{"document_set": ",".join(f"a{i}" for i in range(20)), "flow": [{"type": "filter", "where": "d = 9"}]}]
    frame = spark.read.schema(LOG).parquet(str(tmp_path / "in/log"))
    task = build_task(spark, s, lambda _r, _n: frame)
    plan = task.shared["out"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and set(task.outputs) == set()
    spark.sparkContext.setJobGroup("fan", "fan")
    written = write_task(task, s)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and written == {f"out/x{i}": {"rows": 5} for i in range(20)}
    # a set can be read like a file target, and looked up by its name
    assert sorted(spark.read.parquet(str(tmp_path / "out/target=x7")).columns) == ["d", "id"]


def test_sets_with_other_columns_share_the_folder(spark, tmp_path, log):
    s = spec(tmp_path, "parquet")
    s["pipeline"] = [{"document_set": "a", "flow": [{"type": "map", "set": {"e": "d + 1"}, "drop": ["d"]}]}]
    write_task(build_task(spark, s), s)
    rows = spark.read.parquet(str(tmp_path / "out")).where("id = 3").collect()
    assert sorted((r.target, r.d, r.e) for r in rows if r.target != "x") == [("log", 7.0, None), ("y", 7.0, None)]
    assert [(r.d, r.e) for r in rows if r.target == "x"] == [(None, 8.0)]


def test_one_stream_for_all_aliases(spark, tmp_path, log):
    running = start_task(spark, spec(tmp_path), str(tmp_path / "run"), once=True)
    assert set(running) == {"a", "b", "c"} and len({q.id for q in running.values()}) == 1
    running["a"].awaitTermination()
    assert counts(stream_metrics(spark, str(tmp_path / "run"))) == LINES and stored(spark, tmp_path) == {"x": 2, "y": 4, "log": 4}
    letters = sorted((r.stage, r.alias) for r in spark.read.parquet(str(tmp_path / "run/errors")).collect())
    assert letters == [("delivery", "a")] * 2 + [("delivery", "b")] * 2 + [("delivery", "c")] * 2 + [("pipeline", "a")]
    # a restart goes on after what was read
    spark.createDataFrame([(9, 7, "insert", 3.0)], LOG).write.mode("append").parquet(str(tmp_path / "in/log"))
    for query in start_task(spark, spec(tmp_path), str(tmp_path / "run"), once=True).values():
        query.awaitTermination()
    assert stored(spark, tmp_path) == {"x": 3, "y": 5, "log": 5}


def test_fan_out_over_a_one_to_many_lookup_keeps_the_aliases_apart(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string").write.parquet(str(tmp_path / "in/items"))
    spark.createDataFrame([(1, "t"), (1, "s")], "item int, tag string").write.parquet(str(tmp_path / "in/tags"))
    relate = {"type": "relateInline", "assoc_type": "1n", "relate_resource_id": "in", "relate_document_set": "tags", "layer_type": "sib",
              "field_map": {"s.id": "id", "r.tag": "tag"}, "wheres": [{"src_field": "id", "operator": "=", "rel_field": "item"}]}
    again = {**relate, "field_map": {"s.id": "id", "s.tag": "tag", "r.tag": "other"}, "wheres": [{"src_field": "id", "operator": "=", "rel_field": "item"}]}
    s = {
        "resource": [{"id": "in", "type": "parquet", "path": str(tmp_path / "in")}, {"id": "out", "type": "parquet", "path": str(tmp_path / "out"), "partitioned": True}],
        "source": [{"resource_id": "in", "sync_mode": "direct", "document_set": {"items": ["a", "b"]}, "extra": {"pk": "id"}}],
        "target": [{"resource_id": "out", "document_set": {"a": "x", "b": "y"}}],
        "pipeline": [{"document_set": "a,b", "flow": [relate, again]}],
    }
    shared = {r: n for r, n in [(r, 1) for r in build_task(spark, s).shared]}
    alone = {**s, "resource": [s["resource"][0], {**s["resource"][1], "partitioned": False}]}
    expected = {name: sorted(map(str, df.select("id", "tag", "other").collect())) for (_, name), df in build_task(spark, alone).outputs.items()}
    got = build_task(spark, s).shared["out"]
    assert shared == {"out": 1} and expected["x"]
    for name, rows in expected.items():
        assert sorted(map(str, got.where(got[TARGET_SET] == name).select("id", "tag", "other").collect())) == rows


@pytest.mark.parametrize("change", [{"suffix": ".p"}, {"type": "table"}])
def test_resources_that_cannot_be_partitioned(tmp_path, change):
    s = spec(tmp_path, "parquet")
    s["resource"][1] |= change
    with pytest.raises(SpecError):
        check_task(s)


def test_names_and_options_of_a_partitioned_resource(tmp_path):
    for target in ({"a": "x/y"}, {"a": "x y"}):
        with pytest.raises(SpecError):
            check_task({**spec(tmp_path), "target": [{"resource_id": "out", "document_set": target}]})
    with pytest.raises(SpecError):
        check_task(spec(tmp_path, "parquet", keyed="table", key="id"))
    with pytest.raises(SpecError):
        check_task({**spec(tmp_path), "target": [{"resource_id": "out", "document_set": {"a": "x"}, "extra": {"mode": "overwrite"}}, {"resource_id": "out", "document_set": {"b": "y"}}]})


@pytest.mark.parametrize("partitioned", [False, True])
def test_index_to_index_keeps_ids(spark, tmp_path, partitioned):
    hits = ['{"_index":"i","_id":"7","_source":{"a":1,"_id":"own"}}', '{"_index":"i","_id":"","_source":{"a":null,"_id":"body"}}', '{"_index":"i","_source":{"a":3}}']
    spark.createDataFrame([(h,) for h in hits], "value string").write.text(str(tmp_path / "in/hits"))
    s = {
        "resource": [{"id": "in", "type": "index", "path": str(tmp_path / "in")}, {"id": "out", "type": "index", "path": str(tmp_path / "out"), "partitioned": partitioned}],
        "source": [{"resource_id": "in", "sync_mode": "direct", "document_set": "hits", "extra": {"schema": "a int, _id string"}}],
        "target": [{"resource_id": "out", "document_set": {"hits": "copy"}}],
    }
    write_task(build_task(spark, s), s)
    place = tmp_path / ("out/target=copy" if partitioned else "out/copy")
    assert sorted(r.value for r in spark.read.text(str(place)).collect()) == [
        '{"_index":"copy","_id":"7","_source":{"a":1}}', '{"_index":"copy","_id":"body","_source":{"a":null}}', '{"_index":"copy","_source":{"a":3}}',
    ]
