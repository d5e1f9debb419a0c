"""Every registered query against its SQL on the smallest data set; queries without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck
from tests.conftest import SF_DIR

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# The page lies beyond the ten sellers of the smallest data set.
EMPTY_HERE = {"t03_seller_page"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    found = differences(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    if name in EMPTY_HERE and found[1:] == ["no rows"]:
        return
    assert not found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_flagship(spark):
    assert entry.entry(spark).columns == ["product_category_name", "total_count"]
