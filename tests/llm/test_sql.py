import pytest
from oracle_check import compare, duck

from loanloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), duck(sf), ORACLES[name]) is None
