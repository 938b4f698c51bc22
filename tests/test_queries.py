"""Every registered query against its SQL, and the driver contract."""

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from ledgerspark.plans.queries import REGISTERED

NAMES = sorted(REGISTERED)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_its_sql():
    assert set(NAMES) <= set(contract.queries())
    assert set(NAMES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["age_bucket", "amount"] and contract.entry(spark).count() == 7


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, small, name):
    n, mine, theirs = differences(spark, con, contract.queries()[name], contract.oracle_sql()[name], small)
    assert not mine and not theirs
    assert n > 0 or name == "recon_variances"
