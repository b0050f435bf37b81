"""Every registered query agrees with its reference SQL."""

import pytest

import __spark_entry__ as contract
import check
from workload import queries as workload


def test_every_query_has_sql():
    assert set(workload.SQL) == set(workload.QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query_agrees_with_sql(spark, con, sf, name):
    assert check.differences(spark, con, name, sf) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["q_id", "qx", "qy", "qz", "tau", "re", "im"]
    assert df.count() == 5 * 500
