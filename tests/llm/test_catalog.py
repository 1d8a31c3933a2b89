"""Queries that SQL can say, against their SQL."""

import pytest

from calibrant.llm.catalog import CHECKS, QUERIES
from checking import compare, connect


@pytest.mark.parametrize("directory", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_against_sql(spark, directory, name):
    folder = f"/root/testdata/{directory}"
    difference = compare(QUERIES[name](spark, folder), connect(folder), CHECKS[name])
    assert difference is None, difference
