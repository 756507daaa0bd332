"""Every query against its oracle on the smallest tables."""

import oracle
import pytest

from lattica import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connection("sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    if name in ORACLES:
        assert not oracle.differences(df, con, ORACLES[name])
    else:
        assert df.count() > 0
