"""The registered queries against their SQL on the smallest tables."""

import oracle
import pytest

from lattica.llm import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert not oracle.differences(df, oracle.connection("sf0.001"), ORACLES[name])
