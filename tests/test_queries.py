"""Every query of the engine against its SQL, on the smallest tables."""

import pytest
from compare import difference, oracle

from larkspur.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert difference(df, con, ORACLE[name]) == ""
    else:
        assert df.count() >= 0 and df.columns
