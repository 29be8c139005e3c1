"""Streams over tables of one file and of several."""

import pytest
from pyspark.sql import functions as F

from rillway.workload import QUERIES


@pytest.mark.parametrize("files", [0, 3])
def test_streams_read_tables_of_any_number_of_files(spark, tmp_path, files):
    """0: a single file that is the table itself, not a folder."""

    def store(name, df):
        path = tmp_path / f"{name}.parquet"
        if files:
            df.repartition(files).write.parquet(str(path))
        else:
            df.toPandas().to_parquet(path, coerce_timestamps="us")

    # what lies beside a table, under a name that begins like its own, is not the table's
    spark.range(5).write.parquet(str(tmp_path / "documents.parquet.old"))
    store("documents", spark.range(30).selectExpr("id AS doc_id", "'en' AS lang", "id + 1 AS n_chars"))
    store("labels", spark.range(0, 30, 3).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    store("events", spark.range(40).selectExpr("id AS event_id", "id % 7 AS user_id", "'signup' AS event_type", "id / 2 AS value", "'{}' AS props"))
    related = QUERIES["stream_relate"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.label != "{}") for r in related) == [(i, i % 3 == 0) for i in range(30)]
    assert QUERIES["stream_batches"](spark, str(tmp_path)).agg(F.count("*"), F.sum("event_id")).first()[:] == (40, 780)
    assert QUERIES["stream_apply_changes"](spark, str(tmp_path)).count() == 7
