from __future__ import annotations

import pytest
from oracle import compare, connect

from spanloom.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        assert compare(df, registry.ORACLE_SQL[name], con) == ""
    else:
        assert df.count() > 0 and len(df.columns) == len(set(df.columns))
