import compare
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 50


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare.differences(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_runs(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0
