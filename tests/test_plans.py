"""Every plan against its oracle on the smallest tables."""

import pytest

from encore.plans import catalog

from tests.oracle import connect, rows

FOLDER = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)
