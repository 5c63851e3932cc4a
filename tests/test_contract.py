"""Driver contract: entry() and every registered query vs its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from rankflow.plans.bindings import QUERIES
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "expected_count" in df.columns


def test_every_query_has_oracle_or_is_documented():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    info = compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name])
    assert info["ok"], info
