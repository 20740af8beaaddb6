"""Every query of the subpackage that SQL can express gives the rows DuckDB gives."""
import pytest
from conftest import SMALL
from oracle import compare, duck

from filingsift.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    _, _, result = compare(spark, con, SMALL, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
