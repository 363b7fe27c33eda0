import pytest

from posthorn.llm import queries
from tests import parity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    parity.compare(spark, parity.connect(SF), SF, queries.QUERIES[name], queries.ORACLE[name])
