import pytest
from oracle import compare

from lumenfold.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert compare(df, ORACLE_SQL[name], SF) == ""
    else:
        assert df.count() > 0
