"""Every query of the score model against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from tallyspark.plans import registry
from tests.compare import connection, differences

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        assert not differences(df, con, registry.SQL[name])
    else:
        rows = df.collect()
        assert rows and all(any(x is not None for x in r) for r in rows)
