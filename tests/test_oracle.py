"""Every named query against its DuckDB SQL (FLEETLENS_SF picks another scale)."""

import os

import pytest

from tests.conftest import SMALL
from tools.compare import connect, difference

import __spark_entry__ as entry_point

SF = os.environ.get("FLEETLENS_SF", SMALL)
QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    result = entry_point.entry(spark)
    assert result.count() > 0
    assert "oee_pct" in result.columns
