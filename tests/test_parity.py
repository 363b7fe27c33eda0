import pytest

import __spark_entry__
from posthorn import catalogue
from tests import parity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    parity.compare(spark, con, SF, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_queries_without_sql_run(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
