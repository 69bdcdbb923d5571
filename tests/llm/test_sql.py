import os

import pytest

from lexshard.llm.queries import QUERIES, SQL
from tests.oracle import DATA, connection, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert same(spark, connection(), QUERIES[name], SQL[name]) > 0
