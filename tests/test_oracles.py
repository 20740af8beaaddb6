"""Every registered query with an SQL statement gives the rows DuckDB gives."""
import pytest
from conftest import SMALL
from oracle import SLOW, compare, duck

import __spark_entry__
from filingsift import catalog

QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(spark, con, name):
    _, rows, result = compare(spark, con, SMALL, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 7 and set(rows[0].asDict()) == {"year", "total", "fraud", "fraud_rate"}


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
