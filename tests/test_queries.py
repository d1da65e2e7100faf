"""Every query with SQL gives what its SQL gives; every other one runs."""

import pytest

from inkfield.queries import catalogue
from tests.compare import assert_same, connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    if name in catalogue.SQL:
        assert_same(df, catalogue.SQL[name], connection(data))
    else:
        assert df.count() > 0  # what they give is held against brute force in test_measures


def test_names():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
