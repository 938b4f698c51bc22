"""The registered queries of the subpackage against their SQL, where there is SQL."""

import duckdb
import pytest
from compare import differences

import __spark_entry__ as contract
from ledgerspark.llm.queries import LLM_ORACLES, LLM_QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{small}/{name}.parquet')")
    return con


def test_one_query_for_each_operator():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in contract.queries()
    assert set(LLM_ORACLES) <= set(LLM_QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, con, small, name):
    n, mine, theirs = differences(spark, con, LLM_QUERIES[name], LLM_ORACLES[name], small)
    assert not mine and not theirs and n > 0
