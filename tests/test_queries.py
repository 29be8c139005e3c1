"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

from rillway.workload import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], FOLDER) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_random_numbers_stay_in_range(spark):
    row = QUERIES["fn_rand"](spark, FOLDER).selectExpr(
        "min(below_ten) a", "max(below_ten) b", "min(from_five) c", "max(from_five) d"
    ).first()
    assert 0 <= row.a <= row.b < 10 and 5 <= row.c <= row.d < 15


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
