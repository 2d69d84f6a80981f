"""Every registered query with an SQL twin must equal DuckDB's answer (sf0.01)."""

import pytest

from paths import SF01
from oracle_check import compare, duck
from specsheet.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF01), con, ORACLE[name])
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
