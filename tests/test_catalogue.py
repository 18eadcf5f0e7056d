"""Every query of the catalogue against its SQL."""

import pytest
from oracle import connect, differences

from eventlake.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, db, name):
    assert differences(QUERIES[name](spark, data), db, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
