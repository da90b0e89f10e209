"""Every query of the catalog runs; those with SQL give the same rows as DuckDB."""

import pytest
from oracle import connect, same

from siftline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same(df, con, catalog.ORACLES[name])
    else:
        assert df.count() > 0
