import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from tickloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# Models have no SQL; their tests check them.
UNWRITTEN = {"extrema_model"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | UNWRITTEN
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    problem, rows = differences(spark, con, QUERIES[name], ORACLES[name], SF)
    assert not problem
    # No price moves by less than 0.25 % in the smallest fixture.
    assert rows > 0 or name == "pct_change_dist"


def test_extrema_model(spark):
    row = entry.queries()["extrema_model"](spark, SF).first()
    assert row["n"] > 400 and row["accuracy"] > 0.5


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["time", "price"]
    assert result.count() > 0
