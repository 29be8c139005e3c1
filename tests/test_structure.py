"""Documents whose structure changes while a stream runs."""

import json
import os

from rillway.sources import structure
from rillway.sources.structure import Version, versions_of

FIRST = {"id": "bigint", "total": "double", "note": "string"}


def lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions_follow_the_changes():
    alters = [(9, {"rename": {"price": "amount"}}), (5, {"rename": {"total": "price", "gone": "x", "id": "note"}, "drop": ["note"], "add": {"note": "int", "id": "string"}})]
    found = versions_of(FIRST, alters)
    assert [v.start for v in found] == [-1, 5, 9]
    assert found[1] == Version(5, {"id": "bigint", "price": "double", "note": "int"}, {"id": "id", "price": "total"})
    assert structure.names_in(found, 0) == {"id": "id", "amount": "total"}  # the new note is not the old one
    assert structure.names_in(found, 2) == {"id": "id", "amount": "amount", "note": "note"}
    at_once = versions_of(FIRST, [(5, {"rename": {"total": "a"}}), (5, {"rename": {"a": "b"}, "drop": ["note"]})])
    assert at_once[1:] == [Version(5, {"id": "bigint", "b": "double"}, {"id": "id", "b": "total"})]


def test_documents_of_all_versions_under_the_latest(spark, tmp_path):
    path = str(tmp_path)
    structure.store_batch(lines(spark, [
        {"pos": 1, "doc": {"id": 1, "total": 1.5, "note": "a"}}, {"pos": 2, "doc": {"id": 2}}, {"pos": 3, "doc": {"id": 3, "total": None}},
    ]), path, FIRST, 0)
    assert rows_of(structure.read_current(spark, path, FIRST)) == [(1, 1, 1.5, "a"), (2, 2, None, None), (3, 3, None, None)]
    # the change and documents on both sides of it in one batch, not in order
    second = lines(spark, [
        {"pos": 6, "doc": {"id": 6, "price": 12, "a.b": "x"}}, {"pos": 4, "doc": {"id": 4, "total": 4.25, "note": "d"}},
        {"pos": 5, "alter": {"rename": {"total": "price"}, "retype": {"price": "decimal(4,1)"}, "drop": ["note"], "add": {"a.b": "string"}}},
    ])
    for _ in range(2):  # a repeated batch counts once
        structure.store_batch(second, path, FIRST, 1)
    found = structure.read_current(spark, path, FIRST)
    assert found.columns == ["_pos", "id", "price", "a.b"] and found.schema["price"].dataType.simpleString() == "decimal(4,1)"
    assert [(r[0], r[1], None if r[2] is None else float(r[2]), r[3]) for r in sorted(found.collect())] == [
        (1, 1, 1.5, None), (2, 2, None, None), (3, 3, None, None), (4, 4, 4.3, None), (6, 6, 12.0, "x")
    ]
    assert structure.refused_lines(spark, path).count() == 0


def test_what_has_no_place_is_refused_with_a_reason(spark, tmp_path):
    path = str(tmp_path)
    structure.store_batch(lines(spark, [
        {"pos": 1, "doc": {"id": "seven"}}, {"pos": 2, "doc": {"id": 2, "more": 1}}, {"pos": 3, "doc": [1]}, {"doc": {"id": 1}}, "{broken", "",
        {"pos": 4, "doc": {"id": 4}}, {"pos": -5, "doc": {"id": 4}},
    ]), path, FIRST, 0)
    assert rows_of(structure.read_current(spark, path, FIRST)) == [(4, 4, None, None)]
    reasons = sorted(r.reason for r in structure.refused_lines(spark, path).collect())
    assert reasons == ["not a bigint: id", *["not a line of the log"] * 4, "not an object", "unknown field: more"]


def test_an_empty_folder_has_the_first_structure(spark, tmp_path):
    found = structure.read_current(spark, str(tmp_path), FIRST)
    assert found.columns == ["_pos", *FIRST] and found.count() == 0


def test_reading_prunes_columns_and_pushes_filters(spark, tmp_path):
    path = str(tmp_path)
    structure.store_batch(lines(spark, [{"pos": 1, "doc": {"id": 1, "total": 2.0}}, {"pos": 2, "alter": {"rename": {"total": "price"}}}]), path, FIRST, 0)
    plan = structure.read_current(spark, path, FIRST).where("price > 1").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "note" not in plan and "GreaterThan(total,1.0)" in plan


def test_a_running_stream_takes_changes_without_a_restart(spark, tmp_path):
    source, path = tmp_path / "log", str(tmp_path / "out")
    source.mkdir()
    write = lambda name, rows: (source / name).write_text("\n".join(map(json.dumps, rows)) + "\n")
    write("1.json", [{"pos": 1, "doc": {"id": 1, "total": 1.0}}])
    running = structure.start_evolving(spark, str(source), path, FIRST, str(tmp_path / "check"), interval="100 milliseconds")
    try:
        running.processAllAvailable()
        write("2.json", [{"pos": 2, "alter": {"add": {"channel": "string"}, "drop": ["note"]}}, {"pos": 3, "doc": {"id": 3, "channel": "web"}}])
        running.processAllAvailable()
        write("3.json", [{"pos": 4, "alter": {"drop": ["channel"]}}, {"pos": 5, "doc": {"id": 5, "channel": "web"}}])
        running.processAllAvailable()
    finally:
        running.stop()
    assert rows_of(structure.read_current(spark, path, FIRST)) == [(1, 1, 1.0), (3, 3, None)]
    assert [r.reason for r in structure.refused_lines(spark, path).collect()] == ["unknown field: channel"]
    assert os.path.isdir(f"{path}/documents/start=2")


def test_no_task_reads_a_whole_batch(spark, tmp_path):
    from pyspark import TaskContext

    seen = str(tmp_path)

    def mark(batches):
        open(f"{seen}/{TaskContext.get().taskAttemptId()}.task", "w").close()
        yield from batches

    rows = [{"pos": i, "doc": {"id": i}} for i in range(20)] + [{"pos": 30, "alter": {"drop": ["note"]}}]
    structure.store_batch(lines(spark, rows).repartition(4).mapInPandas(mark, "value string"), str(tmp_path / "out"), FIRST, 0)
    assert structure.read_current(spark, str(tmp_path / "out"), FIRST).columns == ["_pos", "id", "total"]
    assert len([f for f in os.listdir(seen) if f.endswith(".task")]) == 4
