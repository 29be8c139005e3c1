"""Logs in files: manifests, saved positions, and where streams begin."""

import pytest
from pyspark.sql import functions as F

from rillway.columns import OP, POS
from rillway.operators.steps import SpecError
from rillway.plans.task import build_task, check_task, start_task, target_state
from rillway.sinks.target import KeyedTarget
from rillway.sources import changes, logs
from rillway.streaming import runner

LOG = "k int, op string, a int, file string, offset bigint"


def log_of(spark, *places):
    return spark.createDataFrame([(i, "insert", i, f, o) for i, (f, o) in enumerate(places)], LOG)


PLACES = [("bin.8", 4), ("bin.8", 900), ("bin.9", 50), ("bin.9", 5000), ("bin.10", 4), ("bin.10", 70)]


@pytest.mark.parametrize("saved, manifest, lost, left", [
    (("bin.9", 50), None, "head", [3, 4, 5]),
    (("bin.9", 51), None, "head", [3, 4, 5]),                             # between two changes
    (("bin.8", 900), None, "head", [2, 3, 4, 5]),
    (("bin.10", 70), None, "head", []),
    (("bin.7", 4), [("bin.8", 900), ("bin.9", 5000)], "head", [4, 5]),     # purged; the list ended with bin.9
    (("bin.7", 4), None, "start", [0, 1, 2, 3, 4, 5]),
    (("bin.9", 5001), [("bin.8", 900), ("bin.9", 60)], "head", [3, 4, 5]),  # the file is shorter than that
    (("bin.9", 50), [], "head", [0, 1, 2, 3, 4, 5]),
])
def test_resume_by_manifest(spark, saved, manifest, lost, left):
    log = log_of(spark, *PLACES)
    listed = logs.manifest_of(log) if manifest is None else spark.createDataFrame(manifest, "file string, size bigint")
    out = logs.resume(log, listed, logs.Position(*saved), lost=lost)
    assert sorted(r.k for r in out.collect()) == left


def test_listing_reads_names_and_sizes(spark, tmp_path):
    (tmp_path / "log.1").write_bytes(b"x" * 70)
    (tmp_path / "log.2").write_bytes(b"")
    (tmp_path / "other").write_bytes(b"y")
    listed = logs.listed_files(spark, str(tmp_path), "log.*")
    assert sorted(map(tuple, listed.collect())) == [("log.1", 70)]
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert logs.holds(listed, logs.Position("log.1", 70)) and not logs.holds(listed, logs.Position("log.1", 71))


def test_file_positions(spark):
    df = spark.createDataFrame([("log.000012", 7), ("x-3", 0)], "file string, offset bigint")
    assert [r[0] for r in df.select(logs.file_position(F.col("file"), F.col("offset"))).collect()] == [12 * 2**40 + 7, 3 * 2**40]
    with pytest.raises(Exception, match="without a number"):
        spark.createDataFrame([("log", 7)], "file string, offset bigint").select(logs.file_position(F.col("file"), F.col("offset"))).collect()


def test_a_snapshot_that_is_not_needed_is_not_read(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "rows"))
    rows, log = spark.read.parquet(str(tmp_path / "rows")), log_of(spark, *PLACES)
    kept = logs.unless_held(rows, logs.manifest_of(log), logs.Position("bin.9", 50))
    assert kept.collect() == []
    final = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "EmptyRelation" in final and "FileScan" not in final
    assert logs.unless_held(rows, logs.manifest_of(log), logs.Position("bin.7", 50)).count() == 1000


def test_set_of_64_labels(spark):
    labels = [f"l{i}" for i in range(64)]
    df = spark.createDataFrame([(-(1 << 63),), (3,), (0,), (None,)], "mask bigint")
    assert [r[0] for r in df.select(changes.decode_set(F.col("mask"), labels)).collect()] == ["l63", "l0,l1", "", None]
    with pytest.raises(ValueError):
        changes.decode_set(F.lit(1), [*labels, "one too many"])


def replica_spec(**extra):
    return {
        "resource": [{"id": "in", "type": "parquet", "path": ""}, {"id": "none", "type": "empty"}],
        "source": [
            {
                "resource_id": "in", "sync_mode": "replica", "document_set": {"rows": "r"},
                "extra": {"pk": "k", "changes": "log", "log": {"file": "file", "offset": "offset"}, **extra},
            }
        ],
        "target": [{"resource_id": "none", "document_set": {"r": "r"}}],
    }


def test_replica_goes_on_in_a_log_with_gaps_and_starts_anew_when_files_are_gone(spark):
    rows = spark.createDataFrame([(1, 1), (7, 7)], "k int, a int")
    log = spark.createDataFrame([(1, "update", 5, "b.1", 10), (2, "insert", 6, "b.1", 2000), (1, "delete", None, "b.2", 30)], LOG)
    manifest = {"all": logs.manifest_of(log), "purged": spark.createDataFrame([("b.2", 30)], "file string, size bigint")}

    def frame(saved, listed=None):
        spec = replica_spec(**({} if saved is None else {"resume_after": saved}))
        if listed:
            spec["source"][0]["extra"]["log"]["manifest"] = listed
        return build_task(spark, spec, lambda _r, name: {"rows": rows, "log": log, **manifest}[name]).frames["r"]

    spark.sparkContext.setJobGroup("building", "building")
    built = [frame(None), frame({"file": "b.1", "offset": 500}, "all"), frame({"file": "b.1", "offset": 500}, "purged")]
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    positions = [sorted(r[POS] for r in df.collect()) for df in built]
    at = lambda file, offset: file * 2**40 + offset
    whole = [-1, -1, at(1, 10), at(1, 2000), at(2, 30)]
    assert positions == [whole, [at(1, 2000), at(2, 30)], whole]
    state = {r.k: r.a for r in target_state(built[0], "table", "k").collect()}
    assert state == {2: 6, 7: 7} and "file" not in built[0].columns


@pytest.mark.parametrize("extra", [
    {"resume_after": 5}, {"resume_after": {"file": "a.1"}}, {"log": {"file": "f"}}, {"log": None, "resume_after": {"file": "a.1", "offset": 4}}, {"start": "later"},
])
def test_bad_positions_are_refused(extra):
    with pytest.raises(SpecError):
        check_task(replica_spec(**extra))


# ---- where streams begin

def test_begin_now_reads_nothing_and_goes_on_after_a_restart(spark, tmp_path):
    path, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    put = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int").coalesce(1).write.mode("append").parquet(path)
    follow = lambda limit=None: runner.change_stream(spark, path, "id int", limit)
    put(1, 2)
    put(3)
    spark.sparkContext.setJobGroup("passing over", "")
    runner.begin_now(follow(), checkpoint)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = lambda: sorted(r.id for r in spark.read.schema("id int").parquet(out).collect())
    for ids, expected in (([4], [4]), ([5, 6], [4, 5, 6])):
        put(*ids)
        runner.start_append(follow(1), out, checkpoint, once=True).awaitTermination()
        assert got() == expected


def stream_spec(tmp_path, mode="stream", keyed=True, **extra):
    return {
        "resource": [{"id": "in", "type": "parquet", "path": str(tmp_path / "in")}, {"id": "out", "type": "parquet", "path": str(tmp_path / "out")}],
        "source": [
            {"resource_id": "in", "sync_mode": mode, "document_set": {"rows" if mode == "replica" else "log": "r"}, "extra": {"pk": "k", "changes": "log", "schema": LOG, "log": {"file": "file", "offset": "offset"}, **extra}}
        ],
        "target": [{"resource_id": "out", "document_set": {"r": "state"}, "extra": {"keyed": "table", "key": "k", "compact_every": 1}}],
    }


def put_log(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in/log"))


def run_once(spark, tmp_path, spec):
    for query in start_task(spark, spec, str(tmp_path / "run"), once=True).values():
        query.awaitTermination()
    state = KeyedTarget(spark, str(tmp_path / "out/state"), ["k"], ["a"], "table", POS, OP).read()
    return {} if state is None else {r.k: r.a for r in state.collect()}


def test_stream_task_from_now(spark, tmp_path):
    spec = stream_spec(tmp_path, start="now")
    put_log(spark, tmp_path, (1, "insert", 1, "b.1", 4))
    assert run_once(spark, tmp_path, spec) == {}
    put_log(spark, tmp_path, (2, "insert", 2, "b.1", 50))
    assert run_once(spark, tmp_path, spec) == {2: 2}
    put_log(spark, tmp_path, (2, "update", 3, "b.2", 4))
    assert run_once(spark, tmp_path, spec) == {2: 3}


def test_replica_from_now_takes_the_snapshot_for_what_lies_before(spark, tmp_path):
    spec = stream_spec(tmp_path, "replica", start="now")
    spark.createDataFrame([(1, 10), (2, 20)], "k int, a int").write.parquet(str(tmp_path / "in/rows"))
    put_log(spark, tmp_path, (1, "update", 5, "b.1", 4), (3, "insert", 3, "b.1", 60))  # older than the snapshot
    assert run_once(spark, tmp_path, spec) == {1: 10, 2: 20}
    put_log(spark, tmp_path, (2, "update", 21, "b.1", 90))
    assert run_once(spark, tmp_path, spec) == {1: 10, 2: 21}


@pytest.mark.parametrize("saved, expected", [
    ({"file": "b.1", "offset": 30}, {2: 2, 3: 3, 4: 4}),     # held: what follows it
    ({"file": "b.0", "offset": 30}, {4: 4}),                 # gone: what comes from now on
])
def test_stream_task_from_a_saved_position(spark, tmp_path, saved, expected):
    spec = stream_spec(tmp_path, resume_after=saved)
    put_log(spark, tmp_path, (1, "insert", 1, "b.1", 4), (2, "insert", 2, "b.1", 60), (3, "insert", 3, "b.2", 4))
    run_once(spark, tmp_path, spec)
    put_log(spark, tmp_path, (4, "insert", 4, "b.2", 80))
    assert run_once(spark, tmp_path, spec) == expected


def test_running_replica_with_a_lost_position_loads_anew(spark, tmp_path):
    spec = stream_spec(tmp_path, "replica", resume_after={"file": "b.0", "offset": 9})
    spark.createDataFrame([(1, 10)], "k int, a int").write.parquet(str(tmp_path / "in/rows"))
    put_log(spark, tmp_path, (1, "update", 5, "b.1", 4))
    assert run_once(spark, tmp_path, spec) == {1: 5}
