import pytest
from compare import differs

from ragspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert (x := differs(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)) is None, x[:600]
