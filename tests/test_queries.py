"""All registered queries against their SQL on the given tables."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402

from tests.compare import differences, duck  # noqa: E402
from tests.conftest import SMALL  # noqa: E402

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    if name in ORACLES:
        assert differences(got, con.execute(ORACLES[name]).df()) == ""
    else:
        assert len(got) > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
