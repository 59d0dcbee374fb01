"""Queries that SQL can express, against it."""

import pytest

from quarry.llm import queries
from tests.compare import connection, same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    same(queries.QUERIES[name](spark, SF), connection(SF), queries.ORACLES[name])
