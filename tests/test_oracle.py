"""Every registered query against its SQL in DuckDB."""

import pytest

import catalog
from catalog.check import compare, duck
from tests.conftest import SF

catalog.load()
SLOW = {"i13_cross_validate", "i14_holdout", "i16_random_search", "i10_forest", "i11_boosting"}


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query_matches_sql(spark, connection, name):
    verdict, rows, _ = compare(spark, connection, SF, name)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
