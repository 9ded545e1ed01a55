import pytest
from compare import differs

from ragspark.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert (x := differs(df, ORACLE_SQL[name], SF)) is None, x[:600]
    else:
        assert df.count() > 0
