"""Every registered query with SQL returns the same rows on Spark and DuckDB."""
import pytest
from compare import differences, duck

from collectra.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names_agree():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, con, name):
    assert differences(spark, con, SF, queries()[name], oracle_sql()[name]) is None
