import os

import pytest

from pairforge.llm import queries

from ..oracle import FOLDER, check

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name])
